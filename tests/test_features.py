"""Token ids, the commit walk, streams, the suite, loose rows, canonical JSON and functions for SQL text, on small cases."""

import base64
import datetime
import time
import hashlib
import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import HashMismatch, InvalidRecord
from millrace.functions import canonical, registry
from millrace.operators import dedup as batch_dedup
from millrace.operators import governance, normalise, retrieval, sequences, splits, suite, walk
from millrace.operators import tokens as K
from millrace.plans import tokens as plans
from millrace.plans.registry import QUERIES
from millrace.session import table
from millrace.sources import locks, loose
from millrace.streaming import dedup, logs

DATA = "/root/testdata/sf0.001"


# ---- token ids


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = K.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: [i + 15 for i in own.encode_ordinary(text)]


@pytest.fixture(scope="module")
def words():
    return K.WordIds(*K.public_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(st.sampled_from("abctheing  \n'sll123é☃"), max_size=120)), max_size=6))
def test_ids_are_the_library_s(words, library, texts):
    assert words.encode(texts).to_pylist() == [library(t) if t else [] for t in texts]


def test_long_words_by_queue_and_by_rounds_agree(words, library, monkeypatch):
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdeinorst", k=n)) for n in (30, 47, 48, 49, 50, 400, 3000)] + ["a" * 1000, "ab" * 77]
    assert words.encode(long).to_pylist() == [library(t) for t in long]
    raw = [t.encode() for t in long]
    monkeypatch.setattr(K, "LONG_WORD", 0)
    ids, ends = words.ranks.merge(raw)
    monkeypatch.setattr(K, "LONG_WORD", 10**6)
    again, same = words.ranks.merge(raw)
    assert ids.tolist() == again.tolist() and ends.tolist() == same.tolist()


def test_ids_over_whole_tables(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    for r in QUERIES["tokens_x11_encoded"](spark, DATA).collect():
        ids = library(texts[r.doc_id])
        assert (r.n_ids, r.ids_sha256, r.n_framed) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 0 if len(ids) > 510 else 512)


def test_framing_cap_and_decoding(spark, library, words):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "x y " * 600)]
    df = K.encode(spark.createDataFrame(rows, "id long, text string")).withColumn("framed", K.token_ids(F.col("ids")))
    out = {r.id: r for r in df.collect()}
    assert out[1].framed[:4] == [2, *library("one two"), 3] and len(out[1].framed) == 512 and set(out[1].framed[4:]) == {0}
    assert out[2].ids == [] and out[2].framed[:3] == [2, 3, 0] and out[4].framed == [] and len(out[4].ids) > 510
    back = {r.id: r.again for r in K.decode(df, "framed", "again").collect()}
    assert back == {1: "one two", 2: "", 3: "", 4: ""}
    assert [r.text for r in K.decode(spark.createDataFrame([(None,), ([15 + int(words.ranks.of_byte[255])],), ([6, 14],)], "ids array<int>")).collect()] == [None, "�", ""]
    assert K.special_token_id("[CLS]") == 2
    with pytest.raises(KeyError):
        K.special_token_id("[X]")
    share = K.known_share(spark.createDataFrame([([1, 20, 21],), (None,), ([],)], "ids array<int>")).first()
    assert (share.tokens, share.unknown, round(share.coverage, 6)) == (3, 1, 0.666667)


def test_words_are_merged_once(library):
    own = K.WordIds(*K.public_vocabulary())
    asked = []
    inner = own.ranks.merge
    own.ranks.merge = lambda w: asked.append(list(w)) or inner(w)
    for texts in (["to be or not to be"], ["to be"], [None, ""]):
        own.encode(texts)
    assert sorted(w for call in asked for w in call) == [b" be", b" not", b" or", b" to", b"to"]


# ---- the commit walk


def file(before, after, new="a.py", old=None):
    return {"old_path": old, "new_path": new, "source_before": before, "source": after}


def commit(position, files, **own):
    row = {"repo": "r", "position": position, "hash": f"h{position}", "parents": [f"h{position - 1}"], "author": "me", "author_date": datetime.datetime(2023, 5, 1), "merge": False, "message": "change", "modified_files": files}
    return row | own


COMMITS = "repo string, position long, hash string, parents array<string>, author string, author_date timestamp_ntz, merge boolean, message string, modified_files " + walk.FILES
A, B = "def f():\n    return 1\n", "def f():\n    return 2\n"


def test_walk_follows_the_cascade(spark):
    two = A + "\n\ndef g():\n    return 1\n", B + "\n\ndef g():\n    return 3\n"
    rows = [
        commit(1, [file(A, B)], parents=[]),
        commit(2, [file(A, B)], merge=True),
        commit(3, [file(A, B)], author="renovate[bot]"),
        commit(4, [file(A, B)], message="a typo"),
        commit(5, [file(A, B)], author_date=datetime.datetime(2024, 1, 1)),
        commit(6, [file(A, B)], author_date=None, message=None, author=None, merge=None),
        commit(7, [file(A, B, "a.txt"), file(A, B, "", "old.py"), file(None, B), file(A, None), file("def (", B), file(A, A), file(A, A + "# noqa\n"), file(A, "def h():\n    return 1\n")]),
        commit(8, None),
        commit(9, [file(*two, "z.py"), file(A, B, "y.py")]),
    ]
    df = spark.createDataFrame(rows, COMMITS)
    want = [(1, "a.py", "f"), (6, "a.py", "f"), (7, "old.py", "f"), (9, "z.py", "f"), (9, "z.py", "g"), (9, "y.py", "f")]
    for first in (1, 2, 100):
        out = walk.walk(df, first_slice=first).orderBy("position", "file_number", "node_qualname").collect()
        assert [(r.position, r.file_path, r.node_qualname) for r in out] == want
    assert out[0].commit_sha_before == "0" * 40 and out[1].commit_sha_before == "h5" and out[1].commit_message == ""
    assert (out[0].source_before, out[0].source_after) == (A, B)
    pick = lambda **o: sorted((r.position, r.file_number, r.node_qualname) for r in walk.walk(df, **o).collect())
    assert pick(max_pairs=4, first_slice=2) == [(1, 0, "f"), (6, 0, "f"), (7, 1, "f"), (9, 0, "f")]
    assert pick(from_commit="h6", to_commit="h7") == [(6, 0, "f"), (7, 1, "f")]
    with pytest.raises(KeyError):
        walk.walk(df, from_commit="nowhere")
    assert walk.walk(df.limit(0)).count() == 0 and "position" not in walk.as_pair(walk.walk(df)).columns


def test_a_long_history_is_not_read_to_its_end(spark, monkeypatch):
    sizes = []
    inner = walk.pairs_of
    monkeypatch.setattr(walk, "pairs_of", lambda c: sizes.append(c.count()) or inner(c))
    df = spark.createDataFrame([commit(i, [file(A, B)]) for i in range(60)], COMMITS)
    assert walk.walk(df, max_pairs=7, first_slice=4).count() == 7 and sizes == [4, 8]


def test_a_walk_without_a_limit_has_all_pairs(spark, monkeypatch):
    df = spark.createDataFrame([commit(i, [file(A, B)]) for i in range(60)], COMMITS)
    assert walk.walk(df, max_pairs=None, first_slice=4).count() == 60
    asked = []
    monkeypatch.setattr(plans.W, "walk", lambda c, **o: asked.append(o) or c)
    plans.whole_walk(spark, DATA)
    assert asked[0]["max_pairs"] is None


def test_counts_cut_a_long_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "w " * 40_000), (2, "en", " "), (3, None, None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    found = {r.lang: (r.n, r.over_cap, r.blank) for r in plans.over_cap_counts(spark, str(tmp_path)).collect()}
    assert found == {"en": (2, 1, 1), None: (1, 0, 1)} and time.monotonic() - start < 20


def test_table_function_reads_the_tables_words(spark):
    rows = plans.commits(spark, DATA)
    assert rows.select(F.size("modified_files")).distinct().collect()[0][0] == 3
    assert rows.select(F.col("modified_files")[0]["source_before"]).distinct().count() > 100


# ---- streams


def test_stream_keeps_the_lowest_of_each_batch_and_the_first_of_all(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    kind = "doc_id long, text string, extra string"
    spark.createDataFrame([(5, "a", "x"), (3, "a", "y"), (4, None, "z"), (6, None, "")], kind).coalesce(1).write.mode("append").parquet(source)
    dedup.run_dedup(spark, source, "doc_id long, text string", "text", "doc_id", out, checkpoint)
    spark.createDataFrame([(1, "a", "x"), (7, "b", "y"), (None, "c", "z"), (8, "c", "")], kind).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        # the second time there is nothing new
        dedup.run_dedup(spark, source, "doc_id long, text string", "text", "doc_id", out, checkpoint)
        got = {(r.seq, r.kept, r.kept_seq) for r in spark.read.parquet(out).collect()}
        assert got == {(3, True, 3), (5, False, 3), (4, True, 4), (6, False, 4), (1, False, 3), (7, True, 7), (8, True, 8), (None, False, 8)}
        assert spark.read.parquet(out).count() == 8


def test_metrics_drop_what_comes_after_the_watermark(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def put(*rows):
        data = [(datetime.datetime(2024, 1, 1, h, m), e, s) for h, m, e, s in rows]
        spark.createDataFrame(data, "ts timestamp, event string, seconds double").coalesce(1).write.mode("append").parquet(source)
        logs.run_metrics(spark, source, out, checkpoint)

    put((0, 10, "a", 0.05), (0, 50, "a", 0.5), (1, 5, "b", None))
    put((9, 0, "a", 9.0), (0, 20, "a", 0.1))
    put((9, 30, "a", 0.2), (0, 30, "a", 0.1))
    put((9, 40, "b", 0.2), (0, 30, "b", 0.1))
    found = {(r.start.hour, r.event): (r.n, r.total_seconds, r.buckets) for r in logs.current(spark, out).collect()}
    assert found[(0, "a")][0] >= 3 and found[(9, "a")] == (2, 9.2, [0, 1, 1, 1, 1, 1, 1, 2]) and found[(1, "b")] == (1, None, [0] * 8)
    assert (0, "b") not in found
    lost = {r.event: r.dropped for r in logs.dropped(spark.read.parquet(source), logs.current(spark, out)).collect()}
    assert lost["b"] == 1 and lost["a"] + found[(0, "a")][0] == 4


def test_log_sink_counts_what_it_drops(spark, tmp_path):
    kind = "event string, level string, error_code string, payload string, seed long"
    rows = [("train.step", "info", None, '{"source": "x", "n": {"mail": "a@b.org"}}', 1), ("train.step", "error", "E1", None, None), ("train.step", "debug", None, "[1]", 3), ("train.step", "warn", None, "{", 4)]
    path = str(tmp_path / "log")
    assert logs.write_log(spark.createDataFrame(rows, kind), path) == 2
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert all(list(x) == sorted(x) and x["ts"] for x in lines)
    assert sorted((x["event"], x["level"]) for x in lines) == [("log.dropped", "warn"), ("train.step", "error"), ("train.step", "info")]
    assert {x["payload"].get("count") for x in lines if x["event"] == "log.dropped"} == {2}
    first = next(x for x in lines if x["level"] == "info")
    assert first["payload"] == {"source": "<redacted: source>", "n": {"mail": "<redacted: email>"}} and first["seed"] == 1 and "error_code" not in first
    for bad in (("other", "info", None), ("train.step", "loud", None), ("train.step", "error", None), ("train.step", "info", "E1"), (None, "info", None)):
        with pytest.raises(InvalidRecord):
            logs.write_log(spark.createDataFrame([(*bad, None, None)], kind), str(tmp_path / "bad"))
    assert logs.write_log(spark.createDataFrame([], kind), str(tmp_path / "none")) == 0


# ---- the suite


def test_suite_runs_all_metrics_in_one_scan(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, "u"), ("x", 3, None), (None, 5, "u")], "g string, v long, h string")
    one = suite.Benchmark("B1", df, {"mean": F.avg("v"), "n_odd": F.count_if(F.col("v") % 2 == 1)}, ("g", "h"), {"k": "v"})
    none = suite.Benchmark("B2", df.limit(0), {"mean": F.avg("v")})
    out = str(tmp_path / "suite")
    rows = {(r.benchmark_id, r.group, r.metric): (r.value, r.n) for r in suite.run_suite([one, none], out, 7).collect()}
    assert rows == {
        ("B1", "", "mean"): (3.0, 3), ("B1", "", "n_odd"): (3.0, 3), ("B1", "g=x", "mean"): (2.0, 2), ("B1", "g=x", "n_odd"): (2.0, 2), ("B1", "g=", "mean"): (5.0, 1), ("B1", "g=", "n_odd"): (1.0, 1),
        ("B1", "h=u", "mean"): (3.0, 2), ("B1", "h=u", "n_odd"): (2.0, 2), ("B1", "h=", "mean"): (3.0, 1), ("B1", "h=", "n_odd"): (1.0, 1), ("B2", "", "mean"): (None, 0),
    }
    report = json.loads(spark.read.text(f"{out}/results").first().value)
    assert list(report) == sorted(report) and report["global_seed"] == 7 and report["schema_version"] == "v1"
    assert [b["benchmark_id"] for b in report["benchmarks"]] == ["B1", "B2"] and report["benchmarks"][0]["meta"] == {"k": "v"}
    assert report["benchmarks"][0]["seed"] == int(hashlib.sha256(b"B1:7").hexdigest()[:8], 16)
    assert {"group": "g=x", "metrics": {"mean": 2.0, "n_odd": 2.0}, "n": 2} in report["benchmarks"][0]["groups"]
    plan = suite.results(one)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    for bad in ([], [one, one], [suite.Benchmark("B3", df, {})]):
        with pytest.raises(ValueError):
            suite.run_suite(bad, str(tmp_path / "bad"))


# ---- loose rows, records, canonical JSON, elements of arrays


def test_loose_rows_lose_nothing(spark, tmp_path):
    rows = [{"a": 1}, {"a": 2.5, "b": "x"}, {"a": None, "c": {"d": [1, 2], "e": True}}, {"f": 1}, {"f": {"g": "h"}}, {"f": [1, "two"]}, {"n": None}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [(None,)], "json string")
    path = str(tmp_path / "loose")
    kind = loose.write_loose(df, "json", path)
    assert {f.name: f.dataType.simpleString() for f in kind.fields} == {"a": "decimal(11,1)", "b": "string", "c": "struct<d:array<bigint>,e:boolean>", "f": "variant", "n": "string"} or kind["f"].dataType.simpleString() == "variant"
    back = spark.read.parquet(path)
    got = [json.loads(r[0]) for r in back.select(loose.as_objects(back)).collect()]
    # whole numbers beside fractions come back as the wider of the two: 1 is 1.0
    key = lambda r: json.dumps({k: float(v) if k == "a" else v for k, v in r.items()}, sort_keys=True)
    assert sorted(map(key, got)) == sorted(key({k: v for k, v in r.items() if v is not None}) for r in [*rows, {}])
    with pytest.raises(ValueError):
        loose.write_loose(spark.createDataFrame([("[1]",)], "json string"), "json", str(tmp_path / "bad"))
    loose.write_loose(df.limit(0), "json", str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_records_are_kept_or_rejected_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1,\n "of": {"x": [1, 2]}}')
    (tmp_path / "b.json").write_text('{"id": "one",\n "of": {"x": [1]}}')
    (tmp_path / "c.json").write_text('{"id": 3, ')
    (tmp_path / "d.json").write_text('{"more": 1}')
    kept, rejected = loose.load_records(spark, str(tmp_path), "id long, of struct<x: array<int>>")
    assert sorted((r.id, r.of and r.of.x) for r in kept.collect() if r.id) == [(1, [1, 2])] and kept.count() == 2
    assert sorted(r.file.rsplit("/", 1)[1] for r in rejected.collect()) == ["b.json", "c.json"]


@settings(max_examples=25, deadline=None)
@given(st.text(st.sampled_from('aé☃𝄞"\\\n\r\t\b\f\x00\x1f\x7f/ ~'), max_size=12))
def test_json_strings_are_canonical(spark, text):
    assert spark.range(1).select(canonical.json_string(F.lit(text))).first()[0] == json.dumps(text)


def test_sequence_ids(spark):
    rows = [("r/é", "a\"b", [[1, 2], []], [3]), ("r", "f", [], []), (None, "f", [[1]], None)]
    df = spark.createDataFrame(rows, "repo string, path string, context array<array<int>>, target array<int>")
    got = [r[0] for r in df.select(canonical.sequence_id(F.col("repo"), F.col("path"), F.col("context"), F.col("target"))).collect()]
    want = [hashlib.sha256(json.dumps({"repo": r, "file_path": p, "context_ids": c, "target_ids": t}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for r, p, c, t in rows]
    assert got == want


def test_rules_of_array_elements(spark):
    rule = {"type": "object", "properties": {"a": {"type": ["array", "null"], "items": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer", "minimum": 0}, "c": {"type": "array", "items": {"type": "array", "items": {"type": "string"}}}}}}}}
    rows = [(1, '{"a": []}'), (2, '{"a": null}'), (3, '{"a": [{"b": 1}, {"b": -1}, 5, {"c": [["x", 1], 2]}]}'), (4, '{"a": 1}'), (5, "no"), (6, None), (7, '{"a": [null]}')]
    got = sorted((r.id, r.path, r.rule) for r in governance.violations(spark.createDataFrame(rows, "id long, j string"), "id", "j", rule).collect())
    assert [g for g in got if g[0] == 3] == sorted([(3, "$.a[1].b", "minimum"), (3, "$.a[2]", "type"), (3, "$.a[3].b", "required"), (3, "$.a[3].c[0][1]", "type"), (3, "$.a[3].c[1]", "type")])
    assert {(g[0], g[1]) for g in got if g[0] != 3} == {(4, "$.a"), (5, "$"), (6, "$"), (7, "$.a[0]")}


# ---- functions for SQL text, and what goes into the encoder


def test_registered_functions_equal_the_columns(spark):
    assert registry.register(spark) == registry.register(spark)
    pairs = spark.createDataFrame([(1, A, B), (2, A, A), (3, "def (", B), (4, None, B)], "id long, before string, after string")
    sql = spark.sql("SELECT p.id, n.node_qualname FROM {p} p, LATERAL changed_nodes(p.before, p.after) n", p=pairs).collect()
    assert [tuple(r) for r in sql] == [(r.id, r.qualname) for r in normalise.node_pairs(pairs, "id").collect()] == [(1, "f")]
    assert spark.sql("SELECT macro_f1(t, p, n) FROM VALUES ('a', 'a', 3), ('a', 'b', 1), ('b', 'c', 2) AS v(t, p, n)").first()[0] == pytest.approx((2 * 3 / 7) / 3)


def test_open_lists_of_labellers_and_checks(spark):
    pairs = spark.createDataFrame([(1, A, B), (2, A, A.replace("return", "print(1)\n    return")), (3, "def (", B)], "id long, before string, after string")
    try:
        registry.labeller("shouting")(lambda before, after, b, a: F.when(F.contains(after, F.lit("2")), 0.4))
        registry.check("no-two")(lambda b, a: F.lit(True))
        out = {r.id: (r.intent, r.confidence, r.rejected_by) for r in registry.judged(pairs).collect()}
        assert out == {1: ("shouting", 0.4, "no-two"), 2: ("NONE", 0.0, "side_effect_introduction"), 3: ("NONE", 0.0, None)}
        with pytest.raises(ValueError):
            registry.labeller("shouting")(None)
    finally:
        registry.LABELLERS.pop("shouting"), registry.CHECKS.pop("no-two")


def test_embedding_input_refuses_rather_than_cuts(spark):
    long = "x = '" + "ab cd " * 400 + "'\n"
    out = {r.id: r.token_ids for r in normalise.embedding_input(spark.createDataFrame([(1, "x = 1"), (2, "def ("), (3, long), (4, None), (5, "")], "id long, source string")).collect()}
    assert out[1][0] == 2 and len(out[1]) == 512 and out[2] is out[3] is out[4] is None and out[5][:3] == [2, 3, 0]


# ---- batch dedup, leakage by classes, ranking, masks


def test_exact_dedup_with_null_and_repeated_seqs(spark):
    data = [(None, "only", 0), (1, "a", 1), (1, "a", 2), (2, "a", 3), (None, "b", 4), (5, "b", 5), (None, None, 6), (None, None, 7), (3, "", 8)]
    df = spark.createDataFrame(data, "seq long, t string, row long")
    kept, gone = batch_dedup.exact_dedup(df, "t", "seq")
    k, g = {r.row for r in kept.collect()}, {r.row for r in gone.collect()}
    assert len(k & {1, 2}) == 1 and len(k & {6, 7}) == 1
    assert k - {1, 2, 6, 7} == {0, 5, 8} and k | g == set(range(9)) and not k & g
    assert {r.row for r in kept.where("t IS NULL").collect()} == k & {6, 7}


def test_shingle_hashes_are_the_columns(spark, monkeypatch):
    from millrace.functions import text as X

    monkeypatch.setattr(batch_dedup, "GRAMS_HELD", 3)
    df = spark.createDataFrame([(1, "abcdefg abcdefg"), (2, "ab"), (3, ""), (4, None), (5, "é☃𝄞 x y z é☃𝄞 x")], "id long, t string")
    want = {r.id: sorted(r.h) for r in df.select("id", F.transform(X.char_shingles(F.col("t")), X.hash32).alias("h")).collect()}
    assert {r.id: r.hashes for r in batch_dedup.shingle_hashes(df, "id", "t").collect()} == want


@pytest.mark.parametrize("threshold", [0.3, 0.85, 1.0])
def test_leaks_by_class_equal_all_pairs(spark, threshold):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        base = ["a", "b", "c", "d", "e", "f", "g", "h"][: rng.randint(0, 8)]
        rows.append((i, " ".join(rng.sample(base, len(base)) + [f"x{rng.randint(0, 3)}"] * rng.randint(0, 1)) or None, rng.choice(["train", "val", "test"])))
    df = spark.createDataFrame(rows, "id long, t string, split string")
    order, sets = {"train": 0, "val": 1, "test": 2}, {i: set((t or "").split()) for i, t, _ in rows}
    want = {(a, b) for a, _, s in rows for b, _, u in rows if order[s] < order[u] and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    found = splits.detect_leakage(df, "id", "t", "split", threshold)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)
    gone = {b for _, b in want}
    assert {r.id for r in splits.leaking_rows(*splits.leaks(df, "id", "t", "split", threshold)).collect()} == gone
    assert {r.id for r in splits.without_leaks(df, "id", "t", "split", threshold).collect()} == {i for i, _, _ in rows} - gone


def test_leaks_of_a_large_cluster_hand_on_a_forest_and_leave_no_steps(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.sample(base, 77) + [f"y{i}"]), ("train", "val", "test")[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, t string, split string")
    order, sets = {"train": 0, "val": 1, "test": 2}, {i: set(t.split()) for i, t, _ in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, _, s in rows for b, _, u in rows if order[s] < order[u]}
    want = {pair: j for pair, j in want.items() if j >= 0.85}
    assert len(want) > 2000
    written, settle = {}, splits.settle

    def spied(df, name="step"):
        written[name] = settle(df, name)
        counts[name] = written[name].count()
        return written[name]

    monkeypatch.setattr(splits, "settle", spied)
    for block in (splits.BLOCK, 7):
        # components of more than a block are compared by two blocks each
        monkeypatch.setattr(splits, "BLOCK", block)
        counts = {}
        found = splits.detect_leakage(df, "id", "t", "split")
        assert {(r.a, r.b): r.jaccard for r in found.collect()} == want
        left = {name for name, step in written.items() if os.path.exists(step._settled)}
        assert left == {"members", "similar", "leaks"}
        if block > 90:
            assert counts["forests"] < len(want) / 2


def test_bm25_top_is_the_head_of_the_full_ranking(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, rng.choices(vocabulary, k=rng.randint(0, 25))) for i in range(200)] + [(500, None), (501, [None, "w1"])], "id long, w array<string>").repartition(6)
    asked = spark.createDataFrame([(i, rng.choices([*vocabulary, "none"], k=rng.randint(0, 6))) for i in range(15)] + [(99, None)], "q long, w array<string>")
    full = {}
    for r in retrieval.bm25(docs.where("id < 500"), "id", "w", asked, "q", "w").collect():
        full.setdefault(r.query, []).append((-round(r.score, 6), r.id))
    for limit in (10, 1 << 20):
        got = {}
        for r in retrieval.bm25_top(docs.where("id < 500"), "id", "w", asked, "q", "w", 4, limit=limit).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((-r.score, r.id))
        assert got == {q: sorted(v)[:4] for q, v in full.items()}
    assert retrieval.bm25_top(docs, "id", "w", asked, "q", "w", 1000).where("id >= 500").select("id").distinct().count() == 1
    assert retrieval.bm25_top(docs, "id", "w", asked.limit(0), "q", "w", 4).count() == 0


def test_queries_without_a_vector_have_no_answers(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, []), (5, [9.0]), (None, [1.0, 0.0])], "id long, v array<float>")
    assert {(r["query"], r.id) for r in retrieval.top_k(df, df, "id", "v", 1).collect()} == {(1, 1), (3, 3), (5, 5)}
    assert retrieval.top_k(df, df.limit(0), "id", "v", 1).count() == 0 == retrieval.top_k(df.limit(0), df, "id", "v", 1).count()


@pytest.mark.parametrize("rows", [3, 4096])
def test_blocks_of_queries_meet_all_blocks_of_the_index(spark, monkeypatch, rows):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    asked = df.where("id % 4 = 0")
    want = {(q, i, r) for q in range(0, 60, 4) for r, i in enumerate(sorted(range(60), key=lambda i: (-x[q] @ x[i], i))[:7], 1)}
    assert {(r["query"], r.id, r["rank"]) for r in retrieval.top_k(df, asked, "id", "v", 7).collect()} == want
    pairs = [(q, (q * 7) % 60) for q in range(0, 60, 4)]
    given = spark.createDataFrame([(q, t, x[q].tolist(), x[t].tolist()) for q, t in [*pairs, pairs[0]]] + [(1, 2, None, [1.0])], "query long, target long, qv array<double>, tv array<double>")
    ranks = {(q, t): 1 + sum((-x[q] @ x[i], i) < (-x[q] @ x[t], t) for i in range(60)) for q, t in pairs}
    assert {(r["query"], r.target): r["rank"] for r in retrieval.target_ranks(df, given, "id", "v").collect()} == ranks
    assert {r["rank"] for r in retrieval.target_ranks(df.limit(0), given, "id", "v").collect()} == {1}


def test_mask_draws_each_place_once(spark):
    out = sequences.with_masked(spark.createDataFrame([(7, list(range(100, 400))), (8, []), (9, None)], "k long, ids array<int>"), "ids", "k", 4).collect()
    assert all((m == 4 and x == i) or (m == i and x == -100) for i, m, x in zip(out[0].ids, out[0].masked, out[0].labels, strict=True))
    assert 15 < sum(m == 4 for m in out[0].masked) < 80 and out[1].masked == [] and out[2].masked is None


def test_rows_are_numbered_by_ranges(spark):
    from millrace.operators.places import numbered

    rng = random.Random(1)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", None])) for k in rng.sample(range(10000), 700)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(7)
    assert [r["at"] for r in numbered(df, ["k"]).orderBy("k").collect()] == list(range(700))
    got = {(r.g, r.k): r["at"] for r in numbered(df, ["k"], ["g"]).collect()}
    assert got == {(g, k): sum(h == g and j < k for j, h in rows) for k, g in rows}
    assert numbered(df.limit(0), ["k"], ["g"]).count() == 0


def test_pools_and_audits_are_checked_as_they_are_read(spark, tmp_path):
    pools = spark.createDataFrame([("b1", ["c", "a", "a", "é"]), ("b2", ["x"])], "benchmark string, chunk_ids array<string>")
    locks.write_pools(pools, str(tmp_path / "pools"))
    got = {r.benchmark: (r.pool_size, r.chunk_ids, r.pool_hash) for r in locks.load_pools(spark, str(tmp_path / "pools")).collect()}
    assert got["b1"] == (3, ["a", "c", "é"], hashlib.sha256("a,c,é".encode()).hexdigest()) and got["b2"][0] == 1
    one = {"schema_version": "v1", "benchmark": "b", "pool_size": 1, "chunk_ids": ["x"], "pool_hash": hashlib.sha256(b"y").hexdigest()}
    for change, error in (({}, HashMismatch), ({"pool_size": 0}, InvalidRecord), ({"chunk_ids": ["x", 1]}, InvalidRecord), ({"more": 1}, InvalidRecord), ({"pool_hash": "z"}, InvalidRecord)):
        folder = tmp_path / f"bad{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        (folder / "p.json").write_text(json.dumps(one | change, indent=2))
        with pytest.raises(error):
            locks.load_pools(spark, str(folder), lines=False)
    audit = {"schema_version": "v1.2", "repo": "r", "commit_sha": "0" * 40, "license_spdx": "MIT", "py_files_in_scope": 1, "chunk_count": 2, "median_chunk_token_len": 3, "drop_rate_over_cap": 0.0, "drop_rate_parse_fail": 0, "duplication_rate": 0.3, "secret_scanner_hits": 0, "compile_ok_rate": 0.95, "per_intent_pair_count": {"a": 1}}
    (tmp_path / "audits").mkdir()
    (tmp_path / "audits" / "r.json").write_text(json.dumps(audit, indent=2))
    r = locks.load_audits(spark, str(tmp_path / "audits"), lines=False).first()
    assert (r.compile_gate, r.duplication_gate, r.license_gate, r.secrets_gate, r.gates_pass) == (True, False, True, True, False) and r.per_intent_pair_count == {"a": 1}
    (tmp_path / "audits" / "r.json").write_text(json.dumps(audit | {"per_intent_pair_count": {"a": -1}}))
    with pytest.raises(InvalidRecord, match=r"per_intent_pair_count\.a"):
        locks.load_audits(spark, str(tmp_path / "audits"), lines=False)


def test_ordered_digests(spark):
    from millrace.operators.digests import ordered_digest

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(300)])) for _ in range(900)] + [("c", None)]
    got = {r.g: (r.n, r.digest) for r in ordered_digest(spark.createDataFrame(rows, "g string, v long").repartition(5), "g", "v").collect()}
    want = {g: sorted(str(v) for h, v in rows if h == g and v is not None) for g in ("a", "b", None)}
    assert got == {g: (len(v), hashlib.sha256(",".join(v).encode()).hexdigest()) for g, v in want.items()}


def test_slices_are_written_by_all_tasks(spark, tmp_path):
    from millrace.plans import streams

    rows = spark.range(0, 1000, 1, 4)
    feed = streams._fed(rows, F.col("id") % 2, f"{tmp_path}/fed")
    feed(0)
    feed(1)
    found = spark.read.parquet(f"{tmp_path}/fed")
    assert found.count() == 1000 and len(found.inputFiles()) == 8


def test_the_schedule_has_a_row_an_event(spark):
    events = table(spark, DATA, "events").select("event_id")
    found = QUERIES["schedule_w8_learning_rate"](spark, DATA).select("event_id")
    assert found.count() == events.count() and found.exceptAll(events).count() == 0
