"""SentencePiece by chunks, periodic runs and lexical search: against the library, brute force and SQL; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import queries, runs, search, sentences
from millrace.session import table

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, runs string, item string"
LONG = " ".join(f"w{i % 700}" for i in range(9000))
ODD = [(None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "same text here for all"), (5, "same text here for all"), (5, "same text here for all"), (6, LONG), (None, "ünï cödé ☃ 𝄞 ▁▁x ▁"), (7, "x" * 50000), (8, "a " * 40)]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in ODD], DOCS)


# ---- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentences._processor(sentences.public_path())


TEXT = st.one_of(st.text(st.sampled_from("aeth ▁ \n\t.é☃𝄞\x00<s>/ING"), max_size=60), st.text(max_size=40))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_chunks_give_the_library_s_ids_and_text(library, texts):
    encoded = sentences.ChunkTable(sentences.public_path(), limit=500).encode(pa.array(texts, pa.string()))
    assert encoded.to_pylist() == [library.encode(t) for t in texts]
    assert sentences.PieceTable(sentences.public_path()).decode(encoded).to_pylist() == [library.decode(library.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.integers(0, 300), st.integers(28700, 31999)), max_size=12)), max_size=6))
def test_any_ids_decode_as_in_the_library(library, ids):
    lists = pa.array(ids, pa.list_(pa.int32()))
    assert sentences.PieceTable(sentences.public_path()).decode(lists).to_pylist() == [None if i is None else library.decode(i) for i in ids]


def test_table_starts_anew_beyond_its_limit(library):
    table_ = sentences.ChunkTable(sentences.public_path(), limit=1)
    for texts in (["one two", "two"], ["three one", "two"]):
        assert table_.encode(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]
    assert b"two" in table_.slots and b"three" in table_.slots and len(table_.slots) < 6


def test_each_chunk_is_segmented_once():
    table_ = sentences.ChunkTable(sentences.public_path())
    asked = []
    inner = table_.processor.encode
    table_.processor.encode = lambda c, **o: asked.append(list(c)) or inner(c, **o)
    table_.encode(pa.array(["to be or not to be", "to be"]))
    table_.encode(pa.array(["not to be"]))
    assert Counter(x for call in asked for x in call if x.strip()) == Counter(["to", "be", "or", "not"])


def test_sentencepiece_edge_rows(spark, library):
    out = sentences.decode(sentences.encode(odd(spark)), out="item").collect()
    assert out[0].__fields__ == ["doc_id", "text", "runs", "ids", "item"]
    assert Counter((r.doc_id, tuple(r.ids), r["item"]) for r in out) == Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in ODD)
    empty = spark.createDataFrame([], DOCS)
    assert sentences.encode(empty).count() == 0 and sentences.decode(spark.createDataFrame([], "ids array<int>")).count() == 0
    assert [r.text for r in sentences.decode(spark.createDataFrame([(None,), ([],), ([264, None],)], "ids array<int>")).collect()] == [None, "", "a"]
    with pytest.raises(ValueError):
        sentences.PieceTable(sentences.public_path()).decode(pa.array([[32000]]))


def test_op11_over_the_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    out = queries.QUERIES["op11_sentencepiece"](spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


# ---- periodic runs


def smallest_period(w):
    border, j = [0] * len(w), 0
    for i in range(1, len(w)):
        while j and w[i] != w[j]:
            j = border[j - 1]
        j += w[i] == w[j]
        border[i] = j
    return len(w) - border[-1]


def brute_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, exponent * q) and smallest_period(w[s : i + q]) == q:
                out.append((s, i - s + q, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        part = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        w += part * rng.choice([1, 1, 4]) + [rng.randint(0, 9)] * rng.randint(0, 2)
    return w


@pytest.mark.parametrize("levels", [1, 3, 12])
@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (4, 2), (6, 3)])
def test_runs_match_brute_force(monkeypatch, levels, least, exponent):
    monkeypatch.setattr(runs, "LEVELS", levels)
    rng = random.Random(levels * 100 + exponent)
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        codes = np.array([c for t in texts for c in t], np.int64)
        got = zip(*(c.tolist() for c in runs.find_runs(codes, np.cumsum([0] + [len(t) for t in texts]), least, exponent)), strict=True)
        assert list(got) == [(r, *x) for r, t in enumerate(texts) for x in brute_runs(t, least, exponent)]


def test_long_periods_and_one_word():
    period = np.arange(20000)
    assert [c.tolist() for c in runs.find_runs(np.tile(period, 5), np.array([0, 100000]))] == [[0], [0], [100000], [20000]]
    assert [c.tolist() for c in runs.find_runs(np.zeros(100000, np.int64), np.array([0, 100000]))] == [[0], [0], [100000], [1]]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), s, length, q, 1000 * length // q if found else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest(),
    )


def test_op12_over_the_whole_table(spark):
    rows = table(spark, DATA, "documents").select("doc_id", "text").collect()
    out = queries.QUERIES["op12_periodic_runs"](spark, DATA)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {d for c, d in out.dtypes if not c.endswith("sha256")} == {"bigint"}
    assert sorted(map(tuple, out.collect())) == sorted(expected_runs(r.doc_id, r.text) for r in rows)


def test_runs_edge_rows(spark):
    out = runs.periodic_runs(odd(spark)).collect()
    want = []
    for i, t in ODD:
        w = WORD.findall(t or "")
        found = brute_runs(w) if len(w) < 2000 else [(0, 9000, 700)]
        dropped = {k for s, length, q in found for k in range(s + q, s + length)}
        want.append((i, tuple(found), " ".join(x for k, x in enumerate(w) if k not in dropped)))
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in out) == Counter(want)
    assert "item" in out[0] and runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    planted = queries.with_periods(odd(spark)).collect()
    assert len(planted) == len(ODD) and Counter(r.text for r in planted if r.doc_id is None) == Counter(t for i, t in ODD if i is None)


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k, once=True):
    terms = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scored = []
        for (i, c), n in zip(terms, sizes, strict=True):
            if n:
                m = 50 + 50 * n * n_docs // total
                score = sum((1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, times in asked.items() if c[t])
                if score > 0:
                    scored.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


ITEMS = [(0, "the Cat and the DOG"), (1, None), (2, ""), (None, "bird!"), (3, "dog dog fish42 ünï"), (3, "cat"), (4, "nowhere")]


@pytest.mark.parametrize("once", [True, False])
def test_search_matches_brute_force(spark, monkeypatch, once):
    monkeypatch.setattr(search, "ITEM_BYTES", 150)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 40)
    rng = random.Random(5)
    vocabulary = ["the", "cat", "Dog", "bird", "fish42", "ünï", "ÜNÏ", "x", "y", "z", "und"]
    docs = [(i, " ,".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(7, docs[3][1]), (None, docs[3][1]), (None, None), (900, ""), (901, " .. "), (902, "cat " * 5000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (3, 50):
        out = search.search(df, items, k=k, once=once)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, out.collect())) == brute_search(docs, ITEMS, k, once)


def test_search_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs, items).count() == 0
    assert search.search(spark.createDataFrame([(1, "cat"), (2, None)], docs.schema), items.limit(0)).count() == 0


def test_op13_against_its_rule(spark):
    docs = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    out = queries.QUERIES["op13_lexical_search"](spark, DATA)
    assert Counter(map(tuple, out.select("item_id", "rank", "doc_id", "score").collect())) == brute_search(docs, items, 50)
    ranks = defaultdict(list)
    for r in out.orderBy("item_id", "rank").collect():
        ranks[r.item_id].append(r.rank)
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())
    assert out.where(F.col("score") <= 0).count() == 0
