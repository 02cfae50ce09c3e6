"""Cover-tree links under awkward ids; languages of few texts; the network against plain loops."""

import math

import numpy as np

from tessera.llm import cover_tree, language_id


def test_links_belong_to_vectors_not_to_ids(spark):
    big = 2**60
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 0), (big + 1, [0.0, 1.0], 2), (big + 3, [0.01, 1.0], 2), (None, [0.005, 1.0], 2), (None, [1.0, 1.0], 3), (7, [-1.0, 0.0], 0), (7, [-1.0, 0.01], 0), (7, [0.0, -1.0], 0)]
    out = cover_tree.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (big + 1, 2, big + 1, True), (big + 3, 2, big + 1, False), (None, 2, big + 1, False), (None, 0, None, False), (7, 1, 7, True), (7, 1, 7, True), (7, 0, 7, True)], key=str)


def test_random_ids_and_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 8))
    x = centre[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.06
    ids = [None if k % 17 == 0 else int(v) for k, v in enumerate(rng.integers(0, 150, 300))]
    labels = rng.integers(0, 2, 300).tolist()
    out = cover_tree.embedding_links(spark.createDataFrame(list(zip(ids, x.tolist(), labels, strict=True)), "vec_id long, embedding array<double>, label int"), ball=40).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(link, False)
    root = list(range(300))
    for _ in range(300):
        after = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(300)]
        if after == root:
            break
        root = after
    least = {r: min((ids[i] for i in range(300) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    want = sorted(((ids[i], int(link[i].sum()), least[root[i]]) for i in range(300)), key=str)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == want


def test_languages_of_one_text_are_learned(spark):
    rows = [(f"{chr(97 + k) * 3} {chr(98 + k) * 4} " * 20, f"l{k}") for k in range(6) for _ in range(2000)]
    net = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=50)
    assert net.languages == tuple(f"l{k}" for k in range(6))
    few = language_id.fit(spark.createDataFrame(rows + [("zz", "l5")] * 10, "text string, lang string"), sample=3)
    assert len(few.languages) == 3 and "l5" in few.languages
    out = language_id.predict(spark.createDataFrame(rows[::500], "text string, lang string"), net)
    assert out.where("lang = lang_pred").count() >= 16 and out.count() == 24


def test_probabilities_are_those_of_plain_loops():
    rng = np.random.default_rng(1)
    net = language_id.train([(k, bytes(rng.integers(97, 123, 40).tolist())) for k in ("a", "b", "c") for _ in range(9)], per_width=2, embed=3, window=16, epochs=1)
    windows = rng.integers(0, 256, (5, 16 + net.widest - 1)).astype(np.uint8)
    widths = [2, 2, 3, 3, 4, 4]
    for row, got in zip(windows, net.probabilities(windows), strict=True):
        z = [float(b) for b in net.out_bias]
        for f, width in enumerate(widths):
            best = max(sum(float(net.embed[row[p + k], e]) * float(net.filters[k * 3 + e, f]) for k in range(width) for e in range(3)) for p in range(16))
            h = max(0.0, best + float(net.bias[f]))
            z = [a + h * float(o) for a, o in zip(z, net.out[f], strict=True)]
        total = sum(math.exp(a) for a in z)
        assert np.allclose(got, [math.exp(a) / total for a in z], rtol=1e-4)
