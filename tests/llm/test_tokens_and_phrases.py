"""Alignment, transducer counts and collocations against plain versions."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment, collocations, queries, token_transducer

ALPHABET = "  \t\n\r '''strvmdle EXa1²9½é漢字क्ि😀!?,.\x00\x1c‍▁<|endoftext|>"
ODD = ["", "'", "''s", "don't 's", "'re 'r 'l 'll I've 'rx 'l", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x" * 5000, "ü" * 9000, " " * 3000 + "a", "a  b\n\nc\t d", "ab1" * 2000, "▁x"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    anywhere = lambda: chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ODD + ["".join(rng.choice(ALPHABET) if k % 2 else anywhere() for _ in range(rng.randrange(40))) for k in range(n)]


@pytest.fixture(scope="module")
def counter():
    return token_transducer.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoded(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_counts_odd_texts(counter, library):
    texts = random_texts(6000)
    assert counter.counts(texts).tolist() == encoded(library, texts)
    assert counter.counts([None, "a"]).tolist() == [0, 1]


def test_transducer_in_small_slabs_and_tables(library):
    small = token_transducer.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), max_states=500)
    texts = random_texts(500, seed=4) + ["some words and some other words, again and again " * 40]
    assert small.counts(texts, slab=100).tolist() == encoded(library, texts)
    assert len(small.merges.keys) < 60_000


def test_op12_counts_every_text(spark, sf, documents, library):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op12_token_transducer(spark, sf).collect()
    want = dict(zip(texts, encoded(library, list(texts.values())), strict=True))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), want[r["doc_id"]], want[r["doc_id"]] > 1024)


def test_state_maps_compose_to_the_plain_walk():
    rng = np.random.default_rng(2)
    step, mark = token_transducer.segmenter()
    for n in (1, 5, 300, 4001):
        classes = rng.integers(0, 11, n).astype(np.uint8)
        state, out = token_transducer.START, np.zeros(n, bool)
        for i, c in enumerate(classes.tolist()):
            m, state = mark[state, c], step[state, c]
            out[i] |= bool(m & token_transducer.HERE)
            if m & token_transducer.BEFORE:
                out[i - 1] = True
        assert (token_transducer.piece_starts(classes, chunk=7) == out).all()
        assert (token_transducer.piece_starts(classes) == out).all()


def plain_alignment(rows):
    """By the rules, from the two libraries."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(own)))}
    links, out, docs = [], [], Counter()
    for doc_id, text in rows:
        found, one = Counter(), (doc_id, 0, 0, 0, 0, "")
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if all(b"".join(p) == (" " + text).encode() for p in parts):
                ends = [list(itertools.accumulate(map(len, p))) for p in parts]
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = [[[i for i, e in zip(ids[k], ends[k], strict=True) if lo < e <= hi] for k in (0, 1)] for lo, hi in zip([0, *common], common, strict=False)]
                for x, y in groups:
                    found.update(itertools.product(x, y))
                whole = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
                one = (doc_id, len(ids[0]), len(ids[1]), len(groups), found.total(), hashlib.sha256(whole.encode()).hexdigest())
                docs.update(found.keys())
        links.append(found)
        out.append(one)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return sorted(((*o[:5], sum(k for p, k in f.items() if docs[p] == most[p[0]]), sum(k * docs[p] for p, k in f.items()), o[5]) for o, f in zip(out, links, strict=True)), key=str)


@pytest.mark.parametrize("hot", [0, 300, 500_000])
def test_op11_is_the_plain_alignment(spark, documents, hot):
    rows = [(r["doc_id"], r["text"]) for r in documents.where("doc_id < 60").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(random_texts(60, seed=5))] + [(None, "no id"), (7, None), (7, "twice twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.align(df, hot_pairs=hot, unit=3000).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_alignment(rows)


def test_op13_equals_sql(spark, duck, sf):
    want = sorted(duck.execute(queries.ORACLE_SQL["op13_collocations"]).fetchall())
    got = queries.op13_collocations(spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert want and sorted(map(tuple, got)) == want


def plain_phrases(rows, least, covered, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    out = defaultdict(list)
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            lang, *ws = p
            if any(100 * b >= covered * a and len(q) > len(p) and q[0] == lang and any(list(q[i : i + len(ws)]) == ws for i in range(1, len(q))) for q, b in f.items() if b >= least):
                continue
            s, k = min((2_000_000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k) for k in range(1, len(ws)))
            out[lang].append((-s, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)))


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_op13_is_the_plain_count(spark, block_bytes):
    rng = random.Random(9)
    words = ["a", "b", "c\x00", "D d", "é", "z" * 40]
    rows = [(rng.choice(["en", "en", "en", None, "x"]), "".join(rng.choice(words) + rng.choice(["  ", " ", " ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(300)] + [("en", None), ("en", ""), (None, "..."), ("q", "one two")]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=12, block_bytes=block_bytes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 12, 80) and got


def test_op13_counts_past_64_bits(spark):
    text = "ha ho " * 200
    got = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), scale=10**17, longest=2).orderBy("rank").collect()
    assert [(r["phrase"], r["score"]) for r in got] == [("ha ho", 200 * 10**17 // 400), ("ho ha", 199 * 10**17 // 400)]


def test_op13_blocks_send_rows_by_shard_not_by_phrase():
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=400)) for _ in range(20)]
    table = pa.table({"block": pa.array([0] * 20, pa.int32()), "lang": ["en", "de"] * 10, "text": texts})
    slots, _ = collocations._slots(list(collocations._of_block(table)), 2, 24)
    cut = collocations._slices(slots)
    answers = pa.table({"block": pa.array([0] * len(cut), pa.int32()), "slice": pa.array([s for s, _, _ in cut], pa.int32()), "bits": [np.packbits(np.ones(b - a, bool)).tobytes() for _, a, b in cut]})
    sent = collocations._counted(2, 24, 5)(table, answers)
    assert len(sent) == 2 * 5
    want = Counter()
    for lang, text in zip(table["lang"].to_pylist(), texts, strict=True):
        ws = text.split()
        want.update([(lang, "")] * len(ws) + [(lang, w) for w in ws] + [(lang, f"{v} {w}") for v, w in itertools.pairwise(ws)])
    twice = pa.concat_tables([sent, sent])
    got = Counter()
    for lang, shard in {(r["lang"], r["shard"]) for r in sent.select(["lang", "shard"]).to_pylist()}:
        own = twice.filter((pc.field("lang") == lang) & (pc.field("shard") == shard))
        found = collocations._summed(40)(own).to_pylist()
        assert not set(got) & {(lang, r["phrase"]) for r in found}
        got.update({(lang, r["phrase"]): r["f"] for r in found})
    assert got == {p: 2 * n for p, n in want.items() if 2 * n >= 40 or not p[1]} and len(want) > 8_000


def test_op11_knows_the_runs_cut_alike():
    both = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), remembered=50)
    seen = Counter()
    for texts in (["the mill of the town, onnting erenenst ontiontion", ""], random_texts(200, seed=6), [None, "the cat"]):
        for n in set(itertools.chain.from_iterable(both.cut(texts))):
            (*_, a), (*_, b) = both.a.of(np.array([n])), both.b.of(np.array([n]))
            seen[bool(both.alike[n])] += 1
            assert both.alike[n] == np.array_equal(a, b)
    assert len(seen) == 2
