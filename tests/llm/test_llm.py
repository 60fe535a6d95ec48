"""Every operator on small tables: brute force, round trips, nulls, empty tables, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, embeddings, groups, language, lines, media, mixing, ngrams, packing, queries, repeats, urls
from millrace.session import BROADCAST, modest, table

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").cache()


def odd_docs(spark):
    long = " ".join(f"w{i % 700}" for i in range(9000))
    data = [(None, None, None, None), (1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, "same text here for all", "en", "b"), (5, "same text here for all", "en", "b"), (5, "same text here for all", "en", "b"), (6, long, "en", "c"), (7, long, "de", "c"), (None, "ünï cödé ☃ 𝄞", "de", "c"), (8, "12345 !!", "en", "c")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in data], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 chat formatting

TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "we[INST]ird\\"]), st.text(st.sampled_from("a\\<s>/[INST]é\n ☃"), max_size=40))


def formatted(spark, turns):
    df = spark.createDataFrame([(1, i, r, t, "x") for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string, formatted string")
    return chat.format_chats(df).orderBy("block", "fragment").collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(TURN, min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    out = formatted(spark, turns)
    assert [t for r in out for t in chat.read_back(r.formatted)] == turns
    t = chat.ChatTemplate()
    loss = [t.unescape(r.formatted.encode()[a:b].decode()) for r in out for a, b in zip(r.loss_starts, r.loss_ends, strict=True)]
    assert loss == [x for r, x in turns if r == "assistant"]
    body = "".join(r.formatted for r in out)
    assert body.count("<s>") == body.count("</s>") == len(turns)


def test_chat_long_conversation_in_fragments(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1200)]
    out = formatted(spark, turns)
    assert len(out) == 3 and [t for r in out for t in chat.read_back(r.formatted)] == turns


def test_chat_large_texts_in_fragments(spark):
    turns = [("user", "x" * 3_000_000), ("assistant", "y" * 3_000_000), ("user", "z")]
    out = formatted(spark, turns)
    assert len(out) > 1 and [t for r in out for t in chat.read_back(r.formatted)] == turns


def test_chat_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], schema)
    out = {r.conv_id: [t for _, t in chat.read_back(r.formatted)] for r in chat.format_chats(df).collect()}
    assert out == {None: [""], 1: ["a", "a", "b"]}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        chat.read_back("loose text")


# ---- 2 repeats


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = [False] * len(r)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                mark[s : s + length] = [True] * length
        out.append((len(r), sum(mark), sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(bytes(b for b, m in zip(r, mark, strict=True) if not m)).hexdigest()))
    return out


def repeat_cases():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = [word(450), word(400), word(399), word(900)]
    texts = [word(rng.randint(0, 500)) + rng.choice(shared) + word(rng.randint(0, 300)) for _ in range(40)]
    texts += ["a" * 1500, "ab" * 700, word(2000)[:1000] * 2, None, "", shared[3], shared[3], "é☃" * 300, "x" + "é☃" * 300]
    return texts


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_against_brute_force(spark, hot):
    texts = repeat_cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, hot=hot).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, 400)


def test_repeats_of_texts_in_parts(spark, monkeypatch):
    """Texts far above a part's size, cut where repeats lie, give what whole texts give."""
    monkeypatch.setattr(repeats, "PART", 700)
    texts = repeat_cases()
    texts += [texts[2] + texts[5] + texts[9] * 3, "q" * 3000 + texts[7] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, 400)


def test_repeats_odd_rows(spark):
    df = odd_docs(spark)
    out = repeats.remove_repeats(df).collect()
    assert len(out) == df.count()
    assert all(r.n_removed == r.n_bytes for r in out if r.doc_id in (6, 7))
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_interval_expansion_finds_common_prefixes():
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(2, 5, 150), [0], rng.integers(2, 5, 150), [1]])
    order, group = repeats.classes(codes, 4, 2)
    text = codes.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for i in range(1, len(order)):
        a, b = text[order[i - 1] :][:4], text[order[i] :][:4]
        assert (group[i] == group[i - 1]) == (a == b)


# ---- 3 line dedup


def brute_lines(rows, k=5, percent=80):
    tokens, order = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            w = "".join(c.lower() if c.isascii() else c for c in line).split()
            if w:
                tokens[key, n] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
                order.append((key, n))
    gone = set()
    for i, b in enumerate(order):
        for a in order[:i]:
            x, y = tokens[a], tokens[b]
            if 100 * len(x & y) >= percent * len(x | y):
                gone.add(b)
                break
    return {key: None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if (key, n) not in gone) for key, text in rows}


def line_cases():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(["x", "Y", "alpha"])
            parts.append(" ".join(w))
        out.append((i, rng.choice(["\n", "\n\n"]).join(parts)))
    return [*out, (60, None), (61, "\n\n"), (62, "Ünï"), (63, "ünï")]


@pytest.mark.parametrize("few", [16, 1])
def test_lines_against_brute_force(spark, few):
    rows = line_cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_removed string").repartition(4)
    assert {r.doc_id: r.text for r in lines.dedup_lines(df, few=few, block=2048 if few > 1 else 5).collect()} == brute_lines(rows)


def test_lines_join_large_groups_once_a_round(spark, monkeypatch):
    plans, real = [], lines.settle
    monkeypatch.setattr(lines, "settle", lambda df, name="step": (plans.append((name, df._jdf.queryExecution().analyzed().toString().count("LeftSemi"))), real(df, name))[1])
    # near misses whose common words are the rarest: sketches let pairs pass that do not link, round after round
    base, rng = [f"w{j}" for j in range(52)], random.Random(1)
    rows = [(i, " ".join(base + [rng.choice("abcdef") for _ in range(8)])) for i in range(80)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), few=1, block=5)
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)
    semi = [n for name, n in plans if name == "pairs"]
    assert 1 in semi and max(semi) == 1


def test_lines_odd_rows(spark):
    out = lines.dedup_lines(odd_docs(spark))
    rows = sorted((r.doc_id or -1, r.n_lines, r.n_removed, (r.text or "")[:22]) for r in out.collect())
    assert len(rows) == 11
    # rows that repeat wholly change alike
    assert [r for r in rows if r[0] in (4, 5)] == [(4, 1, 0, "same text here for all"), (5, 1, 1, ""), (5, 1, 1, "")]
    assert lines.dedup_lines(empty(spark)).count() == 0


# ---- 4 embeddings


def brute_vectors(rows, cosine=0.98):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in rows if label is not None and usable(v)}
    label = {i: c for i, _, c in rows}
    links = defaultdict(set)
    for a in ok:
        for b in ok:
            if a != b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links[a].add(b)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(1500):
        v = centers[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 50 else None))
    rows += [(2000 + i, rows[5][1], 2) for i in range(20)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("nan")] * 16, 1), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(i, v, c, 0) for i, v, c in rows], "vec_id long, embedding array<float>, label int, id int").repartition(5)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert out == brute_vectors(rows)


def test_embeddings_at_the_threshold(spark):
    """The cosine of (±1, 0, ...) and (±49, ±9, ±3, ±3, 0, ...) is 49 / 50, in double precision as well, wherever the components stand and whatever their scale."""
    rng, rows = random.Random(7), []
    for label in range(300):
        places, scale = rng.sample(range(16), 4), 2.0 ** rng.choice([-600, -3, 0, 500])
        a, b = [0.0] * 16, [0.0] * 16
        for p, x in zip(places, (49, 9, 3, 3), strict=True):
            b[p] = x * rng.choice([-1, 1]) * scale
        a[places[0]] = 1.0 if b[places[0]] > 0 else -1.0
        rows += [(2 * label, a, label), (2 * label + 1, b, label)]
        below = list(b)
        below[places[1]] *= 1 + 1e-12
        rows += [(10000 + 2 * label, a, 1000 + label), (10001 + 2 * label, below, 1000 + label)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert out == {i: (1, i - i % 2) if i < 10000 else (0, i) for i, _, _ in rows}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_embeddings_with_null_keys(spark):
    far = [0.0] * 16
    rows = [(1, [1.0, 0.0] + far, 1), (None, [1.0, 0.1] + far, 1), (2, [1.0, 0.15] + far, 1), (3, [0.0, 0.0, 1.0] + far[1:], 1), (None, [0.0] * 17 + [1.0], 1), (None, [0.0] * 17 + [1.0], 1)]
    rows += [(10 + i, [0.0] * i + [-1.0] + [0.0] * (17 - i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (None, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 1, None, True), (None, 1, None, True)]
    assert out == sorted(want + [(10 + i, 0, 10 + i, True) for i in range(5)], key=str)


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- 5 URLs


def brute_host(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def test_urls_hosts_rules_and_mining(spark):
    good = [f"http://site{i}.net/en/{i}" for i in range(200)]
    bad = [f"http://pills{i}.net/buy/cheap/{i}" for i in range(60)]
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/1", "http://a.example.org/en/12?x", "http://org", "http://org/", "http://x.com/fr/#a", "http://notcom/fr/", "http://x.com?u=/de/", "http://x.com/de/y", "a://b://c/d", "http://pills.net/buy/cheap/new", "http://É.ORG/"]
    all_ = good + bad + odd + [good[0]]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(all_)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, i >= 200) for i in range(260)] + [(None, True), (5, None)], "page_id long, bad boolean")
    out = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    assert len(out) == len(all_)
    for i, u in enumerate(all_):
        assert (out[i].host, out[i].path) == brute_host(u)
        fits = [(h + p, v) for v, h, p in urls.RULES if (out[i].host == h or out[i].host.endswith("." + h)) and out[i].path.startswith(p)]
        assert out[i].rule == (max(fits, key=lambda x: len(x[0]))[0] if fits else None)
        if fits:
            assert out[i].verdict == max(fits, key=lambda x: len(x[0]))[1]
    assert all(out[i].verdict == "block" for i in range(200, 260)) and all(out[i].verdict == "allow" for i in range(200))
    assert out[all_.index("http://pills.net/buy/cheap/new")].verdict == "block"


def test_url_rules_against_all_combinations(spark):
    from itertools import combinations

    rng = random.Random(6)
    words = ["buy", "cheap", "news", "win", "en"]
    rows = [(i, "http://a.net/" + "/".join(own := [w for w in words if rng.random() < 0.45]), rng.random() < (0.9 if {"buy", "win"} <= set(own) else 0.3)) for i in range(150)]
    df = spark.createDataFrame([*rows, (None, "http://a.net/lone/x", True), (900, None, True), (901, "http://a.net/buy", None)], "page_id long, url string, bad boolean")
    known = [(frozenset(urls_tokens(u)), bad) for _, u, bad in [*rows, (None, "http://a.net/lone/x", True), (900, None, True)]]
    n, n_bad = len(known), sum(b for _, b in known)
    everywhere = frozenset.intersection(*(t for t, _ in known))
    tested = {}
    for size in range(1, 9):
        for combo in combinations(sorted(set().union(*(t for t, _ in known)) - everywhere), size):
            marks = [b for t, b in known if set(combo) <= t]
            if len(marks) >= max(urls.MIN_SUPPORT * n, urls.MIN_COUNT - 0.5):
                tested[combo] = (hypergeometric(sum(marks), len(marks), n_bad, n) if sum(marks) >= urls.MIN_COUNT else 1.0, sum(marks), len(marks))
    chances = sorted(c for c, _, _ in tested.values())
    most = max((c for i, c in enumerate(chances) if c <= urls.FALSE_SHARE * (i + 1) / len(chances)), default=-1)
    rules = {w: k / m for w, (c, k, m) in tested.items() if c <= most and k >= urls.MIN_COUNT and k / m >= urls.MIN_CONFIDENCE}
    want = {w: c for w, c in rules.items() if not any(set(v) < set(w) and rules[v] >= c for v in rules)}
    got = {tuple(r.words): r.confidence for r in urls.mine(df, "url", "bad").collect()}
    assert got == pytest.approx(want) and 0 < len(want) < len(rules) and "lone" not in {w for r in got for w in r}
    out = urls.filter_urls(df.drop("bad"), df.select("page_id", "bad")).collect()
    # the join by key leaves the row without a key unlabelled
    assert len(out) == 153 and sum(r.page_id is None for r in out) == 1


def hypergeometric(hits, of, bad, n):
    """The tail, in whole numbers; 1 where the share is no higher than among all."""
    from fractions import Fraction
    from math import comb

    if hits * n <= bad * of:
        return 1.0
    return float(Fraction(sum(comb(bad, i) * comb(n - bad, of - i) for i in range(hits, min(of, bad) + 1)), comb(n, of)))


def test_url_chances():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 200)
        bad, of = rng.randint(0, n), rng.randint(1, n)
        hits = rng.randint(max(0, of - (n - bad)), min(of, bad)) if min(of, bad) >= max(0, of - (n - bad)) else 0
        assert urls.chance(hits, of, bad, n) == pytest.approx(hypergeometric(hits, of, bad, n), rel=1e-9)
    assert urls.chance(2000, 4000, 300_000, 1_000_000) < 1e-100 < urls.chance(1300, 4000, 300_000, 1_000_000)


def test_url_rules_planted_in_several_strengths(spark):
    """Of words on 100 of 3000 pages, those with 30 points more bad pages than the rest are found, those with none are not."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        own = [w for w in ("none", "some", "much", "all") if rng.random() < 1 / 30] + [f"n{rng.randint(0, 39)}x"]
        odds = max([0.25, *(p for w, p in (("some", 0.35), ("much", 0.7), ("all", 0.97)) if w in own)])
        rows.append((i, f"http://h{i}.net/" + "/".join(own), rng.random() < odds))
    found = [set(r.words) for r in urls.mine(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), "url", "bad").collect()]
    assert {"much"} in found and {"all"} in found and not any("none" in w or w == {"some"} for w in found)
    # no label follows any word: no rule
    shuffled = [(i, u, rng.random() < 0.26) for i, u, _ in rows]
    assert urls.mine(spark.createDataFrame(shuffled, "page_id long, url string, bad boolean"), "url", "bad").count() == 0


def urls_tokens(url):
    return [t for t in re.split(r"[^a-z0-9]+", (url or "").lower()) if t]


def test_urls_repeated_and_null_keys(spark):
    urls_of = [(1, "http://pills.net/buy"), (1, "http://pills.net/buy"), (1, "http://other.net/"), (None, "http://pills.net/buy"), (None, None)]
    pages = spark.createDataFrame(urls_of + [(10 + i, f"http://x{i}.net/buy") for i in range(8)] + [(30 + i, f"http://y{i}.net/") for i in range(20)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 20) for i in range(10, 50)] + [(10, False), (None, False)], "page_id long, bad boolean")
    out = urls.filter_urls(pages, labels).collect()
    assert Counter((r.page_id, r.url, r.verdict) for r in out if r.page_id in (1, None)) == Counter(
        [(1, "http://pills.net/buy", "block")] * 2 + [(1, "http://other.net/", "allow"), (None, "http://pills.net/buy", "block"), (None, None, "allow")]
    )


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    assert urls.filter_urls(pages, labels).first().verdict == "allow"
    assert urls.filter_urls(pages.limit(0), labels).count() == 0


# ---- 6 mixing


def test_mixing_targets(spark):
    rng = random.Random(1)
    rows = [(f"s{i % 5}" if i % 5 else None, " ".join(["w"] * rng.randint(0, 60))) for i in range(2000)]
    rows = [(i, s, t) for i, (s, t) in enumerate(rows) if s != "s3" or i % 40 == 3]
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, target int")
    out = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t.split())
    names = sorted(s for s in size if s) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            open_.remove(s)
        left = 1.5 * sum(size.values()) - sum(target.values())
    taken = Counter()
    for r in out:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)


def test_mixing_odd_rows(spark):
    out = mixing.mix(odd_docs(spark)).collect()
    assert len(out) == 11 and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(empty(spark)).count() == 0


# ---- 7 media


def test_media_round_trip(spark):
    df = odd_docs(spark).withColumn("media", F.lit("x"))
    out = media.media_columns(df, columns=("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "fingerprint")).collect()
    texts = Counter((r.text or "") for r in df.collect())
    by_hash = {}
    for t in texts:
        raw = t.encode()
        by_hash[hashlib.sha256(raw + b"\0" * (-len(raw) % 64 if raw else 64)).hexdigest()] = raw
    features = defaultdict(set)
    for r in out:
        raw = by_hash[r.payload_sha256]
        stored = media.from_wav(bytes(r.media))
        assert stored[: len(raw)] == raw and len(stored) == r.payload_bytes and r.n_bytes == len(raw)
        assert r.tail_crc32 == zlib.crc32(stored[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.fingerprint == sorted(r.fingerprint)
        features[r.payload_sha256].add((r.feature, r.media_sha256))
    assert all(len(f) == 1 for f in features.values()) and len({f for x in features.values() for f, _ in x}) > 3
    assert media.media_columns(empty(spark)).count() == 0


def test_peaks_of_a_tone():
    t = np.arange(8000)
    samples = (128 + 100 * np.sin(2 * np.pi * 1000 / media.RATE * t)).astype(np.uint8)
    _, f = media.peaks(samples)
    assert Counter(f.tolist())[1000 * media.FRAME // media.RATE] > 0
    assert len(media.fingerprint(samples)) > 0


def test_media_blocks_of_frames_do_not_show(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, media.HOP * 500 + 77).astype(np.uint8)
    whole = media.fingerprint(samples)
    for block in (8, 64, 128):
        monkeypatch.setattr(media, "BLOCK", block)
        assert (media.fingerprint(samples) == whole).all()
    monkeypatch.undo()
    long = np.tile(samples, 2 + media.BLOCK * media.HOP // len(samples))
    assert len(long) > media.BLOCK * media.HOP and (media.peaks(long)[0] >= media.BLOCK).any()


# ---- 8 n-grams


def brute_ngrams(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split(" ")
        w = [x for x in " ".join(w).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def ngram_cases():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 20, 60, 200]))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    return [*rows, (200, None), (201, ""), (202, " \n "), (203, "É é"), (204, "é É")]


@pytest.mark.parametrize("few", [16, 1])
@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngrams_against_brute_force(spark, few, k, percent):
    rows = ngram_cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(4)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.near_duplicates(df, k=k, percent=percent, few=few, block=2048 if few > 1 else 5).collect()}
    assert out == brute_ngrams(rows, k, percent)


def test_ngrams_join_open_groups_once_a_round(spark, monkeypatch):
    plans, real = [], ngrams.settle
    monkeypatch.setattr(ngrams, "settle", lambda df, name="step": (plans.append((name, df._jdf.queryExecution().analyzed().toString().count("LeftSemi"))), real(df, name))[1])
    rows = ngram_cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.near_duplicates(df, k=3, percent=80, few=1, block=5).collect()}
    assert out == brute_ngrams(rows, 3, 80)
    assert "crowd" in dict(plans) and max(n for name, n in plans if name == "pairs") <= 1


def test_ngrams_linked_by_a_null_key_only(spark):
    words = [f"w{i}" for i in range(120)]
    a, n, b = (" ".join(words[i : i + 100]) for i in (0, 8, 16))
    df = spark.createDataFrame([(1, a), (None, n), (2, b), (None, "x y z x y z q"), (3, "another text of no link at all")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in ngrams.near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 1), (None, 1), (2, 1), (None, None), (3, 3)], key=str)


def test_ngrams_odd_rows(spark):
    out = ngrams.near_duplicates(odd_docs(spark)).collect()
    assert len(out) == 11 and {r.component_id for r in out if r.doc_id in (6, 7)} == {6}
    assert ngrams.near_duplicates(empty(spark)).count() == 0


def test_allocation_covers_the_largest_difference():
    firsts = ngrams.bands(80)
    for band in range(30):
        m, twos, spare, drops = ngrams.allocation(band, 80)
        most = firsts[band + 2] - 1
        apart = 2 * most * 20 // 180
        assert (m == 0) == (apart == 0) and (not m or m + twos >= apart + 1 + spare + drops)
    for n in range(1, 3000):
        band = np.searchsorted(firsts, n, "right") - 1
        assert n * 100 // 80 < firsts[band + 2]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 100))
def test_sketches_never_exceed_the_difference(a, extra, cut):
    b = set(sorted(a)[cut:]) | extra or {1}
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    sketches = groups.Sketches(groups.odd_sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])))
    assert sketches.apart(np.array([0]), sketches, np.array([1]))[0] <= len(a ^ b)


def test_hot_groups_drop_their_most_frequent_entries(spark):
    """A set drops as many frequent entries as its scheme allows, and the rest still joins all linked sets."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(common + [f"u{i}w{j}" for j in range(rng.randint(30, 60))]) for i in range(90)]
    texts += [t.replace(f"u{i}w3", "other") for i, t in enumerate(texts[:30])]
    rows = list(enumerate(texts))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=16).collect()}
    assert out == brute_ngrams(rows, 5, 80)


# ---- 9 language


def test_language_held_out_accuracy(spark):
    out = queries.language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    df = odd_docs(spark).withColumn("score", F.lit("x"))
    model = language.train(df, F.lit(True))
    out = language.identify(df, model).collect()
    assert len(out) == 11 and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    none = language.train(empty(spark), F.lit(True))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0


def test_language_many_labels(spark):
    """No labelled language is left out, however many there are."""
    rows = [(i, f"l{i % 230:03d}", f"word{i % 230:03d} " * 3) for i in range(460)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    assert model.languages == sorted({r[1] for r in rows})


# ---- 10 packing


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_path())
    out = packing.pack(docs).collect()
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for d in docs.collect():
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for i, p in enumerate(sorted(pieces[d.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (i, at) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert i == 0 or p.length == 1024
            at += p.length
        assert at == len(ids) and (len(ids) > 1024 or len(pieces[d.doc_id]) == 1)
    n = check_packing(out, 1024)
    assert n <= -(-sum(r.length for r in out) // 1024) * 1.02 + 1


def test_tokens_are_those_of_the_named_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.public_path()), packing.encoder(packing.public_path())
    for text in ["a<|endoftext|>b", "\r\n\t  x", "ünï☃𝄞", "don't 12345", "\u2028 \xa0", "ſK", "a" * 5000, " " * 300]:
        assert own(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_odd_rows(spark):
    out = packing.pack(odd_docs(spark).withColumn("length", F.lit("x"))).collect()
    assert check_packing(out, 1024) >= 1 and sum(r.piece == 0 for r in out) == 11
    assert packing.pack(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12))
def test_solver_uses_every_item_once(counts):
    patterns = packing.solve(counts, 30)
    used = Counter()
    for p, times in patterns:
        assert sum(p) <= 30 and times > 0
        for s in p:
            used[s] += times
    assert used == Counter(counts)


def fewest_bins(items, capacity):
    """By all orders at once: of each subset the fewest bins, then the emptiest last one."""
    least = [(len(items) + 1, 0)] * (1 << len(items))
    least[0] = (0, capacity)
    for mask, (bins, used) in enumerate(least):
        for i, s in enumerate(items):
            if not mask >> i & 1:
                after = (bins, used + s) if used + s <= capacity else (bins + 1, s)
                least[mask | 1 << i] = min(least[mask | 1 << i], after)
        least[mask] = (bins, used)
    return least[-1][0]


def test_reduction_keeps_the_optimum():
    assert packing.reduce({5: 1, 3: 1, 2: 2}, 10)[0][0] == ((5, 3, 2), 1)
    assert packing.reduce({}, 10) == ([], {})
    rng = random.Random(2)
    sizes = Counter()
    for _ in range(600):
        capacity = rng.randint(5, 20)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce(Counter(items), capacity)
        rest = list(Counter(left).elements())
        assert Counter(rest) + sum((Counter({s: n * p.count(s) for s in p}) for p, n in fixed), Counter()) == Counter(items)
        assert all(sum(p) <= capacity for p, _ in fixed)
        assert sum(n for _, n in fixed) + fewest_bins(rest, capacity) == fewest_bins(items, capacity)
        sizes.update(len(p) for p, _ in fixed)
    assert min(sizes[1], sizes[2], sizes[3]) > 30


def test_solver_reaches_the_optimum_on_small_cases():
    from functools import lru_cache

    def best(items, capacity):
        @lru_cache(None)
        def least(left):
            if not left:
                return 0
            first, rest, found = left[0], left[1:], len(left)
            for mask in range(1 << len(rest)):
                own = [x for i, x in enumerate(rest) if mask >> i & 1]
                if first + sum(own) <= capacity:
                    found = min(found, 1 + least(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
            return found

        return least(tuple(sorted(items, reverse=True)))

    rng = random.Random(4)
    worse = 0
    for _ in range(40):
        items = [rng.randint(1, 10) for _ in range(8)]
        n = sum(t for _, t in packing.solve(Counter(items), 10))
        want = best(items, 10)
        assert want <= n <= want + 1
        worse += n > want
    assert worse <= 6


def test_rounds_broadcast_little_and_mark_the_members_of_large_groups_once(spark, monkeypatch):
    name, settle, seen = "spark.sql.autoBroadcastJoinThreshold", ngrams.settle, []

    def spied(df, step="step"):
        seen.append((step, int(spark.conf.get(name)), df._jdf.queryExecution().analyzed().toString().count("Join LeftOuter")))
        return settle(df, step)

    monkeypatch.setattr(ngrams, "settle", spied)
    rows = [(i, " ".join(f"w{i // 8}-{j if j else i}" for j in range(60))) for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get(name)
    spark.conf.set(name, str(10 << 20))
    try:
        ids = {r.doc_id: r.component_id for r in ngrams.near_duplicates(df, few=4).collect()}
        assert spark.conf.get(name) == str(10 << 20)
        spark.conf.set(name, "1024")
        assert modest(lambda df: spark.conf.get(name))(df) == "1024"
    finally:
        spark.conf.set(name, before)
    assert ids == {i: i // 8 * 8 for i in range(16)}
    assert {limit for _, limit, _ in seen} == {BROADCAST}
    # members are joined with their components where they are written as marked, and not again
    assert [joins for step, _, joins in seen if step == "crowd"] == [0]
