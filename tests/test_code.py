"""Source-code operators on small snippets."""

import json

import pytest

from millrace.errors import HashMismatch, InvalidRecord
from millrace.operators import code, mining, normalise
from millrace.sources import files


def test_chunks():
    source = "import os\n\n@d\ndef f():\n    pass\nx = 1\ny = 2\nclass A:\n    class B:\n        async def m(self): pass\n"
    found = [(c["qualname"], c["kind"], c["start_line"], c["end_line"]) for c in code.chunks(source)]
    assert found == [
        ("<interstitial>", "interstitial", 1, 1), ("f", "function", 3, 5), ("<interstitial>", "interstitial", 6, 7),
        ("A", "class", 8, 10), ("A.B", "class", 9, 10), ("A.B.m", "async_function", 10, 10),
    ]
    assert code.chunks("def (") == code.chunks("") == code.chunks(None) == []


def run(spark, pairs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(pairs)], "i int, before string, after string")
    rows = code.with_features(df, {"before": "b", "after": "a"})
    out = rows.select("i", code.safety(F.col("b"), F.col("a")).alias("s"), code.label(F.col("before"), F.col("after"), F.col("b"), F.col("a")).alias("l")).orderBy("i").collect()
    return [r.s for r in out], [(r.l.intent, r.l.confidence) for r in out]


def test_checks_and_labels(spark):
    loop = "def f(xs):\n    r = {}\n    for x in xs:\n        if x:\n            r[x] = 1\n    return r\n"
    pairs = [
        ("def f(): pass\n", "def g(): pass\n"),
        ("def f() -> int: pass\n", "def f() -> str: pass\n"),
        ("def f():\n    raise a.E()\n", "def f():\n    raise E\n"),
        ("def f():\n    os.path.x()\n", "def f():\n    os.y()\n"),
        (None, "x"),
        (loop, "def f(xs):\n    return {x: 1 for x in xs if x}\n"),
        (loop.replace("r[x] = 1", "break"), "def f(xs):\n    return {x: 1 for x in xs if x}\n"),
        ("a: typing.List[int]\nb: Optional[int]\n", "a: list[int]\nb: Optional[int]\n"),
    ]
    checks, labels = run(spark, pairs)
    assert checks == ["public_api", "public_api", None, None, None, None, None, None]
    # a function gone while another is left counts as inlined
    assert labels[0] == ("inline-helper", 0.7)
    assert labels[5] == ("comprehension-rewrite", 0.9) and labels[6] == ("NONE", 0.0)
    assert labels[7] == ("none-typing-modernization", 0.8)


@pytest.mark.parametrize("source", ["", "   ", "def f(:", "\x00", "x" * 10])
def test_features_never_fail(source):
    assert isinstance(code.features(source)["parses"], bool)


def accepted(spark, intent, before, after):
    from pyspark.sql import functions as F

    rows = code.with_features(spark.createDataFrame([(before, after)], "before string, after string"), {"before": "b", "after": "a"})
    return rows.select(code.acceptance(F.lit(intent), F.col("before"), F.col("after"), F.col("b"), F.col("a"))).first()[0]


def test_acceptance_of_unknown_intents_is_an_error(spark):
    assert accepted(spark, "NONE", "x = 1", "x = 2")
    with pytest.raises(Exception, match="unknown intent"):
        accepted(spark, "other", "x = 1", "x = 2")


def test_shapes_follow_the_written_form():
    one_line = code.features("class A:\n    def __init__(self, a, b): self.a = a\n")["classes"][0]
    assert one_line["assigned"] is None and one_line["has_init"]
    assert code.features("try:\n    f()\nexcept KeyError: pass\n")["silent"] == 0
    assert code.features("try:\n    f()\nexcept KeyError:\n    pass\n")["silent"] == 1
    keyword = code.features("class A:\n    def __init__(self, *, a):\n        self.a = a\n")["classes"][0]
    assert keyword["assigned"] is None and keyword["assigns"]


@pytest.mark.parametrize("source", ["", '"""d"""', "def f():\n    'é' 'x'\n    return 'é'  # é@example.org a@example.org\n", "x = 1 # type: ignore\n\n", "class A: 'd'\n", "def f(:", None, "\x00", "x = 'a # noqa'\n"])
def test_normal_form_is_idempotent(source):
    form = normalise.normalise(source)
    assert form is None or normalise.normalise(form) == form


def test_changed_nodes():
    assert normalise.changed_nodes("def f(): return 1\n", "def f(): return 2\n") == [{"qualname": "f", "before": "def f(): return 1\n", "after": "def f(): return 2\n"}]
    assert normalise.changed_nodes(None, "x = 1") == normalise.changed_nodes("def f(:", "def f(): pass") == []
    assert normalise.changed_nodes("def f(): pass\n", "def f(): pass  # noqa\n") == []


def test_files(spark, tmp_path):
    (tmp_path / "vendor" / "root" / "src").mkdir(parents=True)
    root = tmp_path / "vendor" / "root"
    (root / "src" / "a.py").write_text("def f():\n    'd'\n    return 1\n")
    (root / "b.py").write_text("x = 1\n")
    assert sorted(r.path for r in mining.python_files(spark, str(root)).collect()) == ["b.py", "src/a.py"]
    chunks = files.chunk_repo(spark, str(root), ("src",)).collect()
    assert [(c.path, c.qualname, c.normalised) for c in chunks] == [("src/a.py", "f", 'def f():\n    "<DOC>"\n    return 1\n')]
    manifest = files.make_manifest([{"name": "r"}], mining.CUTOFF)
    assert manifest["commit_cutoff_utc"] == "2023-12-31T23:59:59Z"
    assert files.verified_manifest(json.dumps(manifest)) == manifest
    with pytest.raises(HashMismatch):
        files.verified_manifest(json.dumps({**manifest, "repos": []}))
    assert files.front_matter("---\n# c\na: 'b'\n\nc_1: d e\n---\nrest") == {"a": "b", "c_1": "d e"}
    for text in ("a: b\n", "---\n- a\n---\n"):
        with pytest.raises(InvalidRecord):
            files.front_matter(text)
    with pytest.raises(ValueError, match="neither"):
        files.load_rows(spark, "x.csv")
