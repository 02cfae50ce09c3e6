"""Every operator and stage on awkward rows and on none: a row per row, and the values that the docstrings promise."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, collocations, cover_tree, divergence, language_id, license_scan, mixing, packing, quality_classifier, simhash, suffix_dedup, suffix_tree_lm, token_transducer


def run(name, docs, labels=None):
    keep = [F.col("doc_id")]
    return {
        "lm": lambda: suffix_tree_lm.learn_and_score(docs, True, keep=keep),
        "rules": lambda: divergence.divergence_rules(docs),
        "dedup": lambda: suffix_dedup.remove_repeats(docs),
        "mix": lambda: mixing.mix(docs),
        "quality": lambda: quality_classifier.score(docs, quality_classifier.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"))), keep=keep),
        "pack": lambda: packing.pack_documents(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
        "language": lambda: language_id.predict(docs, language_id.fit(docs, per_language=20), keep=keep),
        "license": lambda: license_scan.scan(docs),
        "align": lambda: alignment.align(docs),
        "count": lambda: token_transducer.count_tokens(docs),
    }[name]().collect()


NAMES = ["lm", "rules", "dedup", "mix", "quality", "pack", "simhash", "language", "license", "align", "count"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(nothing, name):
    assert run(name, nothing) == []


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(awkward, name):
    rows = run(name, awkward)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    if name in ("lm", "rules", "dedup", "quality", "simhash", "language", "align", "count"):
        assert len(rows) == awkward.count() and len(by[1]) == 2 and by[1][0][1:-1] == by[1][1][1:-1]
    if name == "lm":
        assert by[2][0]["n_tokens"] == by[4][0]["n_tokens"] == 1 and all(r["score"] < 0 for r in rows)
    if name == "rules":
        assert by[2][0]["n_words"] == 0 and by[2][0]["base_failed"] and not by[2][0]["kept"] and by[5][0]["n_words"] == by[5][0]["n_repeat_words"] == 60_000
    if name == "dedup":
        assert by[8][0]["n_removed"] == by[1][0]["n_bytes"] and by[1][0]["n_removed"] == 0 and by[2][0]["n_bytes"] == 0 and by[6][0]["n_bytes"] == 180_000
    if name == "mix":
        assert not {2, 3, 4, 7} & set(by) and all(r["take_tokens"] <= r["n_tokens"] for r in rows)
    if name == "quality":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "pack":
        assert [r["length"] for r in by[2]] == [1] and sum(r["length"] for r in by[6]) > 2048 and len([r for r in by[1] if r["piece"] == 0]) == 2
    if name == "simhash":
        assert {by[k][0]["fingerprint"] for k in (2, 3, 4, 7)} == {"0" * 16} and {by[k][0]["component_id"] for k in (2, 3, 4, 7)} == {2} and by[None][0]["fingerprint"] != "0" * 16
    if name == "language":
        assert {by[k][0]["lang_pred"] for k in (2, 3, 4, 7, 10)} == {"und"} and by[1][0]["lang_pred"] != "und"
    if name == "license":
        assert [(r["doc_id"], r["license"], r["line"], r["start"]) for r in rows] == [(9, "Apache-2.0", 0, 0)]


    if name == "align":
        assert all((by[k][0]["n_links"], by[k][0]["groups_sha256"]) == (0, "") for k in (2, 3, 7)) and by[4][0]["n_groups"] > 0 and by[5][0]["n_a"] > 60_000 and by[11][0]["n_b"] > 0
    if name == "count":
        assert [(by[k][0]["n_bytes"], by[k][0]["n_tokens"]) for k in (2, 3, 4)] == [(0, 0), (0, 0), (4, 4)] and by[6][0]["n_bytes"] == 180_000 and by[5][0]["over_limit"] and not by[1][0]["over_limit"]


@pytest.mark.parametrize("kind", ["awkward", "nothing"])
def test_collocations_edges(request, kind):
    docs = request.getfixturevalue(kind).withColumns({c: F.lit(1) for c in ("phrase", "f", "a", "block")})
    rows = collocations.collocations(docs).collect()
    if kind == "nothing":
        assert rows == []
    else:
        [fr] = [r for r in rows if r["lang"] == "fr"]
        assert (fr["rank"], fr["phrase"], fr["a"], fr["l"], fr["r"], fr["n"]) == (1, "ab ab ab ab", 59_997, 60_000, 59_998, 60_000)


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [2.0, 0.1], 1), (12, [1e-30, 0.0], 1)]
    out = cover_tree.embedding_links(spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, rep long, m int")).collect()
    assert len(out) == len(rows)
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert links[1] == links[2][:1] + (1,) == (4, 1) and links[11] == (4, 1) and links[12] == (4, 1)
    assert all(links[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert cover_tree.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("kind", ["awkward", "nothing"])
def test_pipeline_stages(spark, request, kind):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert (docs.count() > 0) == (kind == "awkward")


def test_packing_bounds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 2049, 200)
        bins, offsets, n = packing.best_fit_decreasing(sizes, 2048)
        low = packing.lower_bound(sizes, 2048)
        fill = np.bincount(bins, weights=sizes)
        assert low <= n == len(fill) and fill.max() <= 2048 and n >= -(-sizes.sum() // 2048)
    assert packing.lower_bound(np.array([1100, 1100, 1100]), 2048) == 3
