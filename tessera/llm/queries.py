"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, collocations, cover_tree, divergence, language_id, license_scan, mixing, packing, quality_classifier, simhash, suffix_dedup, suffix_tree_lm, token_transducer
from tessera.llm.common import fold, table

MIX_WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    return suffix_tree_lm.learn_and_score(docs, ~held_out, keep=[F.col("doc_id"), held_out.alias("held_out")])


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = divergence.divergence_rules(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return quality_classifier.score(docs, model, keep=[F.col("doc_id"), (fold("doc_id", 5) == 0).alias("held_out")])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_links(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    return language_id.predict(docs, net, keep=[F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held_out")])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_tree_lm, op2_divergence_rules, op3_suffix_dedup, op4_mixing, op5_quality_classifier, op6_best_fit_packing, op7_simhash, op8_cover_tree, op9_language_id, op10_license_scan, op11_alignment, op12_token_transducer, op13_collocations)
}


def _filled(source: str, budget: str, parent: str, name: str, weight: str) -> str:
    """The water-filling of one level, as in ``mixing.leaf_budgets``."""
    over = f"partition by {parent} order by cap / w, {name}"
    return f"""select *, greatest(0.0, least(cap, max(water) over (partition by {parent}) * w)) as given from (
        select *, ({budget} - coalesce(sum(cap) over ({over} rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over ({over} rows between current row and unbounded following) as water
        from (select *, {weight} as w from {source}))"""


def _case(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {w}::double" for k, w in MIX_WEIGHTS[level].items()) + " else 1.0::double end"


MIXING_SQL = f"""
with docs as (
  select *, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') as bigint), 0) % 4) as domain from (
    select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents)
  where n_tokens > 0),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as supply, sum(n_tokens)::double * 2 as cap from docs group by all),
domains as (select domain, sum(cap) as cap from leaves group by all),
d as ({_filled("(select *, sum(cap) over () / 2 * 0.8 as total from domains)", "total", "1", "domain", _case("domain"))}),
languages as (select domain, lang, sum(cap) as cap from leaves group by all),
l as ({_filled("(select domain, lang, languages.cap, d.given as above from languages join d using (domain))", "above", "domain", "lang", _case("lang"))}),
s as ({_filled("(select leaves.domain, leaves.lang, source, supply, leaves.cap, l.given as above from leaves join l on leaves.domain = l.domain and leaves.lang = l.lang)", "above", "domain, lang", "source", "1.0::double")}),
epochs as (select *, least(leaf_supply, leaf_budget - (epoch - 1) * leaf_supply) as room from (
  select domain, lang, source, supply as leaf_supply, floor(round(given, 4))::bigint as leaf_budget, unnest([1, 2])::int as epoch from s)),
placed as (
  select *, sum(n_tokens) over (partition by domain, lang, source, epoch order by place, doc_id, n_tokens rows unbounded preceding) - n_tokens as start from (
    select docs.*, epoch, leaf_supply, leaf_budget, room, md5('mix:' || epoch || ':' || coalesce(doc_id::varchar, '')) as place
    from docs join epochs using (domain, lang, source) where room > 0))
select doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, room - start)::bigint as take_tokens, leaf_supply, leaf_budget from placed where start < room
"""

_CHARS = (r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^\x20\x09-\x0D]", r"[^#*$%&|<>]", None, r"[\x00-\x7F]")


def _half(p: str, q: str) -> str:
    """One cell's share of twice the Jensen-Shannon divergence."""
    return f"(case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end + case when {q} > 0 then {q} * log2(2 * {q} / ({p} + {q})) else 0 end)"


def _chars() -> str:
    own = [f"length(regexp_replace(t, '{c}', '', 'g'))" if c else None for c in _CHARS]
    own[5] = "length(t) - (" + " + ".join(x for x in own if x) + ")"
    return "[" + ", ".join(f"({x})::double" for x in own) + "]"


RULES_SQL = f"""
with d as (select doc_id, lang, coalesce(text, '') as t, row_number() over () as rid from documents),
pieces as (select rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
w as (select rid, unnest(ws) as w, unnest(range(len(ws))) as i from pieces),
g as (select rid, i, w, lead(w) over o as w1, lead(w, 2) over o as w2 from w window o as (partition by rid order by i)),
again as (select rid, i from (select *, count(*) over (partition by rid, w, w1, w2) as n from g where w2 is not null) where n > 1),
covered as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from again) group by rid),
lines as (select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
stats as (
  select d.*, len(ws) as n_words, length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(lines.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, {_chars()} as classes
  from d join pieces using (rid) left join lines using (rid) left join covered using (rid)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats),
good as (select * from base where lang is not null and not base_failed),
cells as (select rid, lang, unnest(classes) as c, unnest(range(7)) as k from base where not base_failed),
char_refs as (select lang, k, sum(c) / sum(sum(c)) over (partition by lang) as q from cells where lang is not null group by lang, k),
char_own as (select rid, k, c / sum(c) over (partition by rid) as p from cells),
char_least as (select rid, min(v) as v from (select rid, r.lang, sum({_half("p", "q")}) / 2 as v from char_own join char_refs r using (k) group by rid, r.lang) group by rid),
short as (
  select rid, lw, count(*)::double as n from (select rid, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lw from w)
  where regexp_full_match(lw, '[a-z\\x{{80}}-\\x{{10FFFF}}]{{1,4}}') group by rid, lw),
top as (
  select lang, lw, n / words as q from (
    select lang, lw, sum(n) as n, row_number() over (partition by lang order by sum(n) desc, lw) as k from short join good using (rid) group by lang, lw)
  join (select lang, sum(n_words) as words from good group by lang) using (lang) where k <= 40),
pairs as (
  select b.rid, top.lang, q, coalesce(n, 0) / n_words as p from base b cross join top left join short s on s.rid = b.rid and s.lw = top.lw where not base_failed and n_words >= 100),
word_least as (
  select rid, min(v) as v from (
    select rid, lang, (sum({_half("p", "q")}) + {_half("(1 - sum(p))", "greatest(0.0, 1 - sum(q))")}) / 2 as v from pairs group by rid, lang) group by rid)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and coalesce(c.v <= 0.08, true) and coalesce(x.v <= 0.115, true) as kept
from base left join char_least c using (rid) left join word_least x using (rid)
"""

PHRASES_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps from documents),
p as (select lang, doc, unnest(ps) as t, unnest(range(len(ps))) as piece from pieces),
ws as (select lang, doc, piece, regexp_extract_all(t, '[^\x20\x09]+') as ws from p),
w as (select lang, ws, unnest(range(len(ws)))::int as i from ws),
grams as (select lang, array_to_string(ws[i + 1 : i + k], ' ') as phrase, k from w, (select unnest([1, 2, 3, 4])::int as k) where i + k <= len(ws)),
f as (select lang, phrase, k, count(*)::bigint as f from grams group by all),
total as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, phrase, f as a, k, string_split(phrase, ' ') as ws from f where k > 1 and f >= 30),
cuts as (select *, unnest(range(1, k)) as j from c),
scored as (
  select c.lang, c.phrase, a, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f::hugeint + y.f))::bigint as score, j
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1 : j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(ws[j + 1 : ], ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, j) = 1),
parts as (select lang, a, ws, k, unnest(range(2, k)) as m from c where k > 2),
inner_ as (select lang, a, array_to_string(ws[b : b + m - 1], ' ') as phrase from (select *, unnest(range(1, k - m + 2)) as b from parts)),
longer as (select lang, phrase, max(a) as longer from inner_ group by all),
kept as (select s.* from scored s left join longer g using (lang, phrase) where g.longer is null or 100::hugeint * g.longer < 80::hugeint * s.a)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank from kept) join total using (lang) where rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op2_divergence_rules": RULES_SQL, "op4_mixing": MIXING_SQL, "op13_collocations": PHRASES_SQL}
