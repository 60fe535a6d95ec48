"""Probe, pooling, ids, redaction, indexes, splits and the checks before a run, on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.errors import HashMismatch, PreflightFailure
from millrace.functions import text as X
from millrace.operators import evals
from millrace.operators.redaction import redact, redacted_json
from millrace.sources import files


def test_logistic_probe_against_gradient_descent(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 240)
    x = (rng.standard_normal((3, 4)) * 1.2)[y] + rng.standard_normal((240, 4))
    w, b, hot = np.zeros((4, 3)), np.zeros(3), np.eye(3)[y[:120]]
    for _ in range(20000):
        p = np.exp(z := x[:120] @ w + b - (x[:120] @ w + b).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.3 * (x[:120].T @ (p - hot) + w) / 120
        b -= 0.3 * (p - hot).sum(0) / 120
    want = (x[120:] @ w + b).argmax(1)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))] + [(500, None, 1)], "id long, v array<double>, y int")
    out = evals.logistic_probe(df.where("id < 120"), df.where("id >= 120"), "id", "v", "y").collect()
    got = {r.id: r.predicted for r in out}
    assert got.pop(500) is None and [got[i] for i in range(120, 240)] == want.tolist()
    assert (want == y[120:]).mean() > 0.6
    one = evals.logistic_probe(df.where("y = 1"), df.limit(2), "id", "v", "y").collect()
    assert {r.predicted for r in one} == {1}
    assert {r.predicted for r in evals.logistic_probe(df.limit(0), df.limit(2), "id", "v", "y").collect()} == {None}


def test_mean_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([], []), (None, None)], "s array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(X.mean_pooled(F.col("s"), F.col("m"))).collect()] == [[2.0, 4.0], [0.0, 0.0], None, None]


def test_ids_follow_time(spark):
    df = spark.sql("SELECT timestamp_millis(1000 * id) AS at FROM range(200)")
    ids = [r.i for r in df.select("at", X.time_ordered_id(F.col("at")).alias("i")).orderBy("at").collect()]
    assert ids == sorted(ids) and len(set(ids)) == 200
    import uuid

    assert {(uuid.UUID(i).version, uuid.UUID(i).variant) for i in ids} == {(7, uuid.RFC_4122)}


def test_redaction_at_any_depth(spark):
    token = "a" * 40
    shared = {"x": "me@a.org"}
    payload = {"source": "code", "chunk_id": token, "list": [token, {"code": "y" * 300}, 5, None], "a": shared, "b": shared, "long": "é" * 2049}
    out = redact(payload, "info")
    assert out == {"source": "<redacted: source>", "chunk_id": token, "list": ["<redacted: hex_token>", {"code": "<redacted: source>"}, 5, None], "a": {"x": "<redacted: email>"}, "b": {"x": "<redacted: email>"}, "long": "<redacted: too_long>"}
    assert redact(payload, "debug")["list"][1]["code"] == "y" * 256 + "…" and payload["source"] == "code"
    assert redact({"source": {"k": token}}, "info") == {"source": {"k": "<redacted: hex_token>"}}
    payload["self"] = payload
    assert redact(payload, "info")["self"] == "<redacted: cycle>"
    df = spark.createDataFrame([(json.dumps({"k": token}), "info"), (None, "info"), (f"no json {token}", None), ("", "debug")], "p string, l string")
    got = [r[0] for r in df.select(redacted_json(F.col("p"), F.col("l"))).collect()]
    assert [None if g is None else json.loads(g) for g in got] == [{"k": "<redacted: hex_token>"}, None, "no json <redacted: hex_token>", ""]


def test_index_halves_must_fit(spark, tmp_path):
    df = spark.createDataFrame([("c1", [1.0, 0.0], "s"), (None, None, None)], "chunk_id string, vector array<double>, source string")
    files.write_index(df, str(tmp_path), "aaaa1111-bbbb2222")
    assert files.load_index(spark, str(tmp_path), "aaaa1111-bbbb2222", "aaaa", "bbbb2222").count() == 2
    for halves in ({"checkpoint": "bbbb"}, {"manifest": "aaaa"}):
        with pytest.raises(HashMismatch):
            files.load_index(spark, str(tmp_path), "aaaa1111-bbbb2222", **halves)
    with pytest.raises(Exception, match="already exists"):
        files.write_index(df, str(tmp_path), "aaaa1111-bbbb2222")


def test_splits_and_sequences(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, None), (4, "other")], "id int, split string")
    files.write_splits(df, str(tmp_path / "s"))
    assert {k: [r.id for r in v.collect()] for k, v in files.load_splits(spark, str(tmp_path / "s")).items()} == {"train": [1], "test": [2]}
    files.write_splits(df.where("split = 'other'"), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no split"):
        files.load_splits(spark, str(tmp_path / "t"))
    seq = spark.createDataFrame([("r", "f", [[1], []], None, 3, "id", 9)], "repo string, file_path string, context_ids array<array<bigint>>, target_ids array<int>, intent_idx int, sequence_id string, x int")
    for name in ("q.parquet", "q.jsonl"):
        files.write_sequences(seq, str(tmp_path / name))
        assert [tuple(r) for r in files.load_rows(spark, str(tmp_path / name), files.SEQUENCES).collect()] == [("r", "f", [[1], []], None, 3, "id")]


def test_preflight_names_all_failures(tmp_path):
    path, figures = tmp_path / "m.json", tmp_path / "b.json"
    with pytest.raises(PreflightFailure) as e:
        files.preflight(str(path), str(figures))
    assert e.value.failed == ["manifest_exists_and_valid", "audit_gates", "baseline_metrics"]
    figures.write_text("{}")
    good = {"repos": [], "manifest_hash": "", "audits": [{"passes_all_gates": True}, "a/path.json"]}
    good["manifest_hash"] = files.manifest_hash(good)
    path.write_text(json.dumps(good))
    assert all(files.preflight(str(path), str(figures)).values())
    for audits in ([{}], {"a": {"passes_all_gates": False}}, [5], "text"):
        path.write_text(json.dumps({"audits": audits}))
        with pytest.raises(PreflightFailure, match="audit_gates"):
            files.preflight(str(path))
    path.write_text(json.dumps({**good, "manifest_hash": "0"}))
    with pytest.raises(PreflightFailure, match="manifest"):
        files.preflight(str(path))


def test_baselines_and_human_scores(tmp_path):
    assert files.missing_baselines(str(tmp_path)) == list(files.BASELINES)
    for name in files.BASELINES:
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text("{}")
    assert files.missing_baselines(str(tmp_path)) == []
    assert files.human_scores(str(tmp_path))["status"] == "no_human_annotations"
    (tmp_path / "human_annotations.json").write_text('{"mean_likert": 4}')
    assert files.human_scores(str(tmp_path)) == {"mean_likert": 4.0, "cohen_kappa": 0.0, "status": "ok"}
