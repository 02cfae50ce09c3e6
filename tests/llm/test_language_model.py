"""What a score uses does not depend on the share that a word or a run has of the corpus."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_tree_lm


def test_a_context_of_tiny_share_is_a_state(spark):
    """After "xjk" comes "v", after "yjk" comes "w", 40 times each: below a millionth of what surrounds them."""
    rare, rest = [("xjkv yjkw " * 40,)], [("the river runs by the mill and " * 40_000,)] * 50
    docs = spark.createDataFrame(rare + rest, "text string").repartition(4)
    out = suffix_tree_lm.learn_and_score(docs.unionAll(spark.createDataFrame([("xjkv",), ("yjkv",)], "text string")), F.length("text") > 5, depth=3)
    got = {r["text"]: r["score"] for r in out.where("length(text) < 5").collect()}
    assert got["xjkv"] - got["yjkv"] > 1


def test_rows_that_teach_nothing(spark):
    rows = suffix_tree_lm.learn_and_score(spark.createDataFrame([("ab",), (None,), ("ab",)], "text string"), False).collect()
    assert sorted(round(r["score"] / math.log10(256), 6) for r in rows) == [-4.0, -4.0, -1.0] and all(r["train_tokens"] == 0 == r["base_score"] for r in rows)


def test_map_columns_and_depth(spark):
    docs = spark.createDataFrame([(1, "a b", {"k": 1}), (2, None, None)], "doc_id long, text string, m map<string,int>")
    assert len(suffix_tree_lm.learn_and_score(docs, True, keep=[docs["doc_id"]]).collect()) == 2
    for depth in (0, 7):
        with pytest.raises(ValueError):
            suffix_tree_lm.learn_and_score(docs, True, depth=depth)
