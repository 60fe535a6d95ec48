"""Small cases with known outcomes."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import GateFailure, HashMismatch, SplitConflict, UnknownRepo
from millrace.functions import text as X
from millrace.operators import audit, components, dedup, evals, governance, mining, retrieval, sequences, splits
from millrace.plans.registry import QUERIES


def rows(spark, n, groups=1, empty=()):
    data = [(f"g{g}", i, [] if (g, i) in empty else [g, i]) for g in range(groups) for i in range(n)]
    return spark.createDataFrame(data, "g string, i int, w array<int>")


@pytest.mark.parametrize(("n", "groups", "h", "p", "stride", "want"), [(10, 1, 3, 1, 1, 6), (5, 1, 3, 1, 1, 1), (4, 1, 3, 1, 1, 0), (5, 2, 3, 1, 1, 2), (5, 1, 2, 2, 1, 1), (10, 1, 3, 1, 2, 3)])
def test_windows(spark, n, groups, h, p, stride, want):
    out = sequences.build_sequences(rows(spark, n, groups), ["g"], "i", "w", h, p, stride).collect()
    assert len(out) == want
    for r in out:
        assert len(r.context) == h and r.target[1] == r.start + h


def test_windows_skip_empty_rows(spark):
    assert sequences.build_sequences(rows(spark, 5, 1, {(0, 2)}), ["g"], "i", "w").count() == 0


@pytest.mark.parametrize(("texts", "kept"), [(["a", "a", "b"], 2), (["x"] * 5 + ["y"], 2), ([None, None, ""], 2), ([], 0)])
def test_exact_dedup(spark, texts, kept):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    k, r = dedup.exact_dedup(df, "t", "id")
    assert (k.count(), r.count()) == (kept, len(texts) - kept)


def test_minhash_matches_whole_numbers():
    a, b = dedup.hash_pairs(8)
    import hashlib

    text = "the quick brown fox"
    h = [int(hashlib.sha1(text[i : i + 5].encode()).hexdigest()[:8], 16) for i in range(len(text) - 4)]
    want = [min((int(x) * v + int(y)) % dedup.PRIME for v in h) for x, y in zip(a, b, strict=True)]
    assert dedup.signature(text, 8).tolist() == want
    assert dedup.signature("", 4).tolist() == [dedup.PRIME] * 4


def test_shingles_are_cut_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "abc", "\U0001f600 wide ones", *("".join(rng.choices("abcdé \n", k=rng.randint(5, 900))) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    want = {i: sorted(int(hashlib.sha1(g.encode()).hexdigest()[:8], 16) for g in dedup._grams(x)) if x else [] for i, x in enumerate(texts)}
    for held, least, few in ((1 << 21, 512, 64), (100, 8, 0), (2000, 1, 0)):
        for name, v in (("GRAMS_HELD", held), ("LEAST", least), ("FEW", few)):
            monkeypatch.setattr(dedup, name, v)
        parts = list(dedup._cut(iter(texts)))
        assert sum(n for n, _, _ in parts) == len(texts) and (len(parts) > 1) == (held < 1 << 21)
        assert [sorted(h[at].tolist()) for _, h, each in parts for at in each] == [want[i] for i in range(len(texts))]
        found = np.concatenate([dedup._least(dedup._columns(h, 128), each) for _, h, each in parts])
        assert (found.astype(np.int64) == np.array([dedup.signature(x) for x in texts])).all()
    assert {r.id: r.hashes for r in dedup.shingle_hashes(df, "id", "t").collect()} == want
    assert {r.id: r.signature for r in dedup.signatures(df, "id", "t").collect()} == {i: dedup.signature(x).tolist() for i, x in enumerate(texts)}


def test_lsh_needs_whole_bands(spark):
    with pytest.raises(ValueError):
        dedup.lsh_dedup(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t", n=10, bands=3)


def test_needed_bands_take_all_slots():
    ends = dedup.band_ends(0.85, 128, 32)
    assert len(ends) == 20 and ends[0][0] == 0 and ends[-1][1] == 128 and all(b == c for (_, b), (c, _) in zip(ends, ends[1:]))
    assert min(b - a for a, b in ends) == 6
    assert dedup.band_ends(0.5, 128, 32) == [(4 * i, 4 * i + 4) for i in range(32)]


def test_lsh_groups_near_copies(spark):
    base = "one two three four five six seven eight nine ten " * 8
    df = spark.createDataFrame([(5, base), (3, base), (9, base + "!"), (1, "something else entirely")], "id long, t string")
    assert {r.id: r.component for r in dedup.lsh_dedup(df, "id", "t").collect()} == {5: 3, 3: 3, 9: 3, 1: 1}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_local_components(links):
    nodes, roots = components.local_components(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    least = {n: n for n in nodes.tolist()}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == least


@pytest.mark.parametrize("whole", [1000, 0])
def test_components_of_a_path(spark, whole):
    ids = list(range(40))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (100, 101), (None, 3), (7, 7)], "a long, b long").repartition(4)
    out = {r.node: r.component for r in components.components(df, "a", "b", whole).collect()}
    assert out == {i: 0 for i in range(1, 40)} | {101: 100}


def test_splits(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "repo string, id long")
    assert {r.id: r.split for r in splits.assign_splits(df, "repo", {"a": "train", "b": "val", "c": "ood"}).collect()} == {1: "train", 2: "val"}
    with pytest.raises(UnknownRepo):
        splits.assign_splits(df, "repo", {"a": "train"})
    with pytest.raises(ValueError):
        splits.assign_splits(df, "repo", {}, by_repo=False)
    with pytest.raises(SplitConflict):
        splits.split_lock(spark.createDataFrame([("a", "train"), ("a", "val")], "repo string, split string"), "repo", "split")


def test_leakage(spark):
    df = spark.createDataFrame([(1, "x y z", "train"), (2, "z y x", "test"), (3, "x y z", "train"), (4, "", "val"), (5, "q", "val")], "id long, t string, split string")
    assert {(r.a, r.b) for r in splits.detect_leakage(df, "id", "t", "split").collect()} == {(1, 2), (3, 2)}
    assert splits.detect_leakage(df, "id", "t", "split", 1.01).count() == 0


def test_gates(spark):
    base = {"n_tokens": 3, "file_path": "f", "over_cap": False, "duplicate": False, "license": "MIT", "n_secrets": 0}
    data = [base | {"repo": "r", "parse_failed": i < 10} for i in range(110)]
    a = audit.audit(spark.createDataFrame(data), "repo")
    r = a.first()
    assert r.chunk_count == 100 and not r.compile_gate and round(r.compile_ok, 3) == 0.909
    with pytest.raises(GateFailure) as e:
        audit.check_all_gates(a, "repo")
    assert e.value.failures == [("r", "compile_gate")]


def test_secrets(spark):
    df = spark.createDataFrame([(1, "AKIA" + "A" * 16), (2, "ghp_" + "a" * 36), (3, None), (4, "eyJab.cd.ef"), (5, "0" * 32)], "id long, t string")
    assert {(r.id, r.pattern_name) for r in audit.secret_hits(df, "id", "t").collect()} == {(1, "aws_access_key"), (2, "github_pat"), (4, "jwt"), (5, "hex_token")}


def test_redaction(spark):
    df = spark.createDataFrame([("mail a.b@c.org",), ("x" * 4097,), ("a" * 64,)], "t string")
    assert [r[0] for r in df.select(X.redacted(F.col("t"))).collect()] == ["mail <redacted: email>", "<redacted: too_long>", "<redacted: hex_token>"]
    assert df.select(X.redacted(F.col("t"), "manifest_hash")).collect()[2][0] == "a" * 64


def test_commit_filters(spark):
    df = spark.createDataFrame([(1, True, "a", "ok"), (2, False, "renovate[bot]", "ok"), (3, False, None, "a template"), (4, None, None, None), (5, False, "a", "ok")], "id int, m boolean, a string, t string")
    assert [r.id for r in df.where(mining.commit_passes(F.col("m"), F.col("a"), F.col("t"))).collect()] == [4, 5]
    dates = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2023, 12, 31, 23, 59, 59)), (3, None)], "id int, d timestamp_ntz")
    assert [r.id for r in dates.where(mining.before_cutoff(F.col("d"))).collect()] == [2, 3]
    assert mining.cutoff_text() == "2023-12-31T23:59:59Z"


def test_python_files(spark, tmp_path):
    for name, body in {"a.py": b"x = 1", "b_pb2.py": b"", "vendor/c.py": b"", "d.py": b"# DO NOT EDIT", "e.py": b"\xff\xfe", "f.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert [r.text for r in mining.python_files(spark, str(tmp_path)).collect()] == ["x = 1"]


def test_pool(spark):
    df = spark.createDataFrame([(i,) for i in [3, 1, 2, 3, 1]], "id int")
    assert {r.id for r in sequences.build_pool(df, "id", 3, 1).collect()} == {1, 2, 3}
    for size in (0, 4):
        with pytest.raises(ValueError):
            sequences.build_pool(df, "id", size, 1)


def test_softmax_and_refusals(spark):
    df = spark.createDataFrame([(1, 10, 0.9, 1, True), (1, 11, 0.9, 2, True), (1, 12, 0.1, 3, False), (2, 10, 0.5, 1, False)], "query long, id long, score double, rank int, ok boolean")
    out = retrieval.rerank(df, F.col("ok"), 10)
    assert sorted((r.query, r.id, r.confidence) for r in out.collect()) == [(1, 10, 0.5), (1, 11, 0.5), (1, 12, 0.0), (2, 10, 0.0)]
    asked = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "query long, embedded boolean")
    codes = {r.query: (r.refusal or "")[:4] for r in retrieval.refusals(asked, out).collect()}
    assert codes == {1: "R005", 2: "R006", 3: "R004", 4: "R001"}


def test_top_k_ties_and_small_index(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    out = retrieval.top_k(df, df.where("id = 3"), "id", "v", 5).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in out] == [(1, 1), (3, 2), (2, 3)]


def test_bm25_finds_its_own_entries(spark):
    texts = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota"]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id long, w array<string>")
    scored = retrieval.bm25(df, "id", "w", df.withColumnRenamed("id", "q"), "q", "w").collect()
    assert {(r.query, r.id) for r in scored} == {(0, 0), (1, 1), (2, 2)}


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(5)], "at long, v double")
    r = evals.bootstrap_ci(df, "at", "v").first()
    assert r.mean == 3.0 and r.ci_low < 3 < r.ci_high
    with pytest.raises(ValueError):
        evals.bootstrap_ci(df.limit(1), "at", "v")
    with pytest.raises(ValueError):
        evals.paired_bootstrap_p(df.withColumn("b", F.lit(None).cast("double")), "at", "v", "b")


def hashed_means(values, draws, seed):
    n = len(values)
    places = ([int(int(hashlib.md5(f"{seed}|{d}|{i}".encode()).hexdigest()[:13], 16) / 2**52 * n) for i in range(n)] for d in range(draws))
    return [sum(values[p] for p in at) / n for at in places]


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(3 * i + 1, round(rng.uniform(2000, 6900), 2)) for i in range(40)]
    folder = str(tmp_path_factory.mktemp("customers"))
    spark.createDataFrame(rows[::-1], "c_custkey long, c_acctbal double").repartition(3).write.parquet(f"{folder}/customer.parquet")
    return folder, [v for _, v in rows]


def test_bootstrap_query_takes_every_customer(spark, customers):
    folder, values = customers
    r = QUERIES["stats_a16_bootstrap"](spark, folder).first()
    means = hashed_means(values, 1000, 0)
    assert (r.n, r.n_boot, r.level) == (40, 1000, 0.95)
    want = (np.mean(values), np.std(values, ddof=1), *np.quantile(means, [0.025, 0.975]))
    assert np.allclose((r["mean"], r["std"], r.ci_low, r.ci_high), want, rtol=0, atol=1e-5)


def test_paired_query_takes_every_customer(spark, customers):
    folder, values = customers
    r = QUERIES["stats_a17_paired"](spark, folder).first()
    assert r.n == 40
    assert 0 < r.p < 1 and r.p == np.mean(np.array(hashed_means([v - 4400.0 for v in values], 10_000, 3)) <= 0)


def test_draws_make_no_row_a_pick(spark, monkeypatch):
    values = [float(i * i % 101) for i in range(230)]
    df = spark.createDataFrame([(i, v if i % 9 else None) for i, v in enumerate(values)], "at long, v double").repartition(3)
    picked = [[int(int(hashlib.md5(f"5|{d}|{i}".encode()).hexdigest()[:13], 16) / 2**52 * 230) for i in range(230)] for d in range(12)]
    want = {d: np.mean([values[i] for i in own if i % 9]) for d, own in enumerate(picked)}
    for piece, held in ((1 << 16, 1 << 23), (32, 64)):
        monkeypatch.setattr(evals, "PIECE", piece)
        monkeypatch.setattr(evals, "HELD", held)
        out = evals._resampled(df, "at", "v", 230, 12, 5)
        assert "Join" not in out._jdf.queryExecution().toString() and "Range" not in out._jdf.queryExecution().toString()
        assert {r.draw: round(r["mean"], 9) for r in out.collect()} == {d: round(m, 9) for d, m in want.items()}


def test_schema_violations(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"enum": ["x"]}}}
    df = spark.createDataFrame([(1, '{"a": 2, "b": "x"}'), (2, '{"a": true}'), (3, '{"c": 1}'), (4, '{"a": 1, "b": "y"}')], "id int, j string")
    found = {(r.id, r.path, r.rule) for r in governance.violations(df, "id", "j", schema).collect()}
    assert found == {(2, "$.a", "type"), (3, "$.a", "required"), (3, "$", "additionalProperties"), (4, "$.a", "minimum"), (4, "$.b", "enum")}


def test_locks_and_hashes(tmp_path):
    path = str(tmp_path / "d" / "lock.json")
    governance.write_report({"b": 1, "a": 2}, path, once=True)
    assert open(path).read() == '{\n  "a": 2,\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        governance.write_report({}, path, once=True)
    with pytest.raises(HashMismatch):
        governance.check_hashes({"manifest_hash": "a"}, {"manifest_hash": "b"})
