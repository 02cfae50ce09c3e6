"""Stages of the corpus pipeline against plain versions."""

from collections import Counter

import numpy as np
import pytest
from test_results import WORD, linked, plain_fingerprint

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.queries import MIX_WEIGHTS

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents.select(*COLUMNS).collect(), documents.select(*COLUMNS).schema)


def test_near_duplicates_keeps_the_first_of_each_group(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    roots = linked([plain_fingerprint(t) for _, t in rows], 2)
    want = [rows[k] for k, r in enumerate(roots) if k == r]
    assert sorted((r["doc_id"], r["text"] or "") for r in STAGES["near_duplicates"](spark, docs, None).collect()) == want


def test_different_texts_under_one_id(spark):
    far = ["the river and the old mill by the town", "ein Haus am See und viel Wind im Mai", "une maison pres de la mer avec le vent"]
    rows = [(1, far[0], "en", "s", 1), (1, far[1], "de", "s", 1), (2, far[1], "de", "s", 1), (2, far[2], "fr", "s", 1), (2, far[2], "fr", "s", 1), (None, far[2], "fr", "s", 1), (None, "alone " * 5, "en", "s", 1)]
    got = STAGES["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), None).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, far[0]), (1, far[1]), (2, far[2]), (None, "alone " * 5)])


def test_suffix_dedup_cuts_what_an_earlier_document_has(spark, docs):
    first, want = {}, {}
    for i, t in sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()):
        lost = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first.setdefault(t[k : k + 50], i) < i:
                lost[k : k + 50] = True
        left = bytes(np.frombuffer(t, np.uint8)[~lost]).decode("utf-8", "ignore")
        if WORD.search(left):
            want[i] = left
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["suffix_dedup"](spark, docs, None).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_language_id_rejects_texts_without_letters_only(spark, docs):
    kept = {r["doc_id"] for r in STAGES["language_id"](spark, docs, None).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_mixing_cuts_texts_after_the_taken_words(spark, docs):
    """What is taken is what the operator without texts takes, which has a SQL twin; texts are cut there."""
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = Counter()
    for r in mixing.mix(docs, weights=MIX_WEIGHTS).collect():
        ends = [m.end() for m in WORD.finditer(texts[r["doc_id"]])]
        assert len(ends) == r["n_tokens"]
        text = texts[r["doc_id"]] if r["take_tokens"] == len(ends) else texts[r["doc_id"]][: ends[r["take_tokens"] - 1]]
        want[r["doc_id"], text, len(text)] += 1
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in STAGES["mixing"](spark, docs, None).collect())
    assert got == want
