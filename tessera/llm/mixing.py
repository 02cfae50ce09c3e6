"""Mixing sources to target weights by hierarchical budgeting.

A token budget is propagated through a tree of domains, languages and sources.  At each node the children's shares follow
their weights as far as their subtrees can supply tokens; what one child lacks goes to its siblings, and only what all of
them lack goes up.  Each leaf's budget is met by whole seeded epochs of its documents and a prefix of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import WORD, written

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source that has none of its own: the number at its end, modulo 4."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.coalesce(F.when(digits != "", digits.cast("long")), F.lit(0)) % 4).cast("string"))


def _weight(level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parent: list[str], name: str, budget: Column, level: str, weights: dict[str, float]) -> DataFrame:
    """``nodes`` (with ``cap``) with ``given``: the parent's budget by weight, each child up to its cap, the rest to its siblings.

    With children in order of cap by weight, the water level is the largest of the levels at which all children from some
    place on would share what those before leave.
    """
    order = W.partitionBy(*[F.col(p) for p in parent] or [F.lit(0)]).orderBy(F.col("cap") / F.col("w"), name)
    rows = nodes.withColumn("w", _weight(level, weights)).withColumn("__budget", budget)
    before, after = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("water", (F.col("__budget") - before) / after)
    all_ = W.partitionBy(*[F.col(p) for p in parent] or [F.lit(0)])
    return rows.withColumn("given", F.greatest(F.lit(0.0), F.least("cap", F.max("water").over(all_) * F.col("w")))).drop("water", "w", "__budget")


def leaf_budgets(supply: DataFrame, *, share: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(domain, lang, source, supply, budget) from (domain, lang, source, supply); the budget is ``share`` of all tokens."""
    leaves = supply.withColumn("cap", F.col("supply").cast("double") * max_epochs)
    languages = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = languages.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = F.sum("cap").over(W.partitionBy(F.lit(0))) / max_epochs * share
    domains = _filled(domains.withColumn("total", total), [], "domain", F.col("total"), "domain", weights.get("domain", {}))
    languages = _filled(languages.join(domains.select("domain", F.col("given").alias("above")), "domain"), ["domain"], "lang", F.col("above"), "lang", weights.get("lang", {})).drop("above")
    leaves = _filled(leaves.join(languages.select("domain", "lang", F.col("given").alias("above")), ["domain", "lang"]), ["domain", "lang"], "source", F.col("above"), "source", weights.get("source", {}))
    return leaves.select(*LEVELS, "supply", F.floor(F.round("given", 4)).cast("long").alias("budget"))


def mix(docs: DataFrame, *, share: float = 0.8, max_epochs: int = 2, weights: dict[str, dict[str, float]] | None = None, seed: str = "mix", with_text: bool = False) -> DataFrame:
    """Rows of ``docs`` in each epoch that takes them: with epoch, n_tokens, take_tokens, leaf_supply and leaf_budget.

    Tokens are words.  Null languages and sources are leaves named ``none``; texts without a word supply nothing and are
    never taken; repeated rows supply and are taken each.  In each epoch a leaf's documents come in order of the md5 of
    seed, epoch and id (ties: by id and tokens); ``take_tokens`` is below ``n_tokens`` for at most one of them.  With
    ``with_text`` the other columns of ``docs`` are carried and a document taken in part has its text cut after its last
    taken word.  The order is followed in two steps, first among 4096 ranges of the md5 and then within each, so that one
    leaf with most rows is spread over many tasks.
    """
    own = docs.columns if with_text else ["doc_id", "lang", "source"]
    rows = docs.select(*[docs[c] for c in own], F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"), F.coalesce(docs["lang"].cast("string"), F.lit("none")).alias("__lang"), F.coalesce(docs["source"].cast("string"), F.lit("none")).alias("__source"))
    rows = rows.withColumn("__domain", domain_of(F.col("__source"))).where("n_tokens > 0")
    rows = written(rows)
    leaf = ["__domain", "__lang", "__source"]
    supply = rows.groupBy(*[F.col(c).alias(c[2:]) for c in leaf]).agg(F.sum("n_tokens").alias("supply"))
    budgets = leaf_budgets(supply, share=share, max_epochs=max_epochs, weights=weights or {})
    epochs = budgets.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("supply").alias("leaf_supply"), F.col("budget").alias("leaf_budget"), F.explode(F.sequence(F.lit(1), F.lit(max_epochs))).alias("epoch"))
    epochs = written(epochs.withColumn("__room", F.least("leaf_supply", F.col("leaf_budget") - (F.col("epoch") - 1) * F.col("leaf_supply"))).where("__room > 0"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    offered = rows.join(epochs, leaf).withColumn("__place", place).withColumn("__range", F.substring("__place", 1, 3))
    group = [*leaf, "epoch"]
    ranges = offered.groupBy(*group, "__range").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.withColumn("__start", F.sum("n").over(W.partitionBy(*group).orderBy("__range")) - F.col("n")).drop("n")
    within = W.partitionBy(*group, "__range").orderBy("__place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    placed = offered.join(ranges, [*group, "__range"]).where("__start < __room")
    taken = placed.withColumn("__before", F.col("__start") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    taken = taken.withColumn("take_tokens", F.least("n_tokens", F.col("__room") - F.col("__before"))).where("take_tokens > 0")
    more = ["epoch", "n_tokens", "take_tokens", "leaf_supply", "leaf_budget"]
    if with_text:
        cut = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, int(take_tokens)), '')")
        return taken.withColumn("text", F.when(F.col("take_tokens") < F.col("n_tokens"), cut).otherwise(F.col("text"))).select(*own, *more)
    return taken.select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), *more)
