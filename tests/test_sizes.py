"""What queries move: bytes that their plans write to shuffles, on tables made for it."""

import random

import pytest

from millrace.operators import governance
from millrace.plans import corpus


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.fixture
def moved(spark):
    """The result's rows and the bytes that the plan shuffled."""

    def run(plan, folder):
        before = shuffled(spark)
        rows = plan(spark, folder).collect()
        return rows, shuffled(spark) - before

    return run


def test_dedup_report_moves_no_texts(spark, moved, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=20_000)) for _ in range(50)]
    rows = [(i, texts[i % 50]) for i in range(60)] + [(60, None), (61, ""), (62, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    found, size = moved(corpus.dedup_report, str(tmp_path))
    assert [(r.total, r.exact, r.near, r.retained) for r in found] == [(63, 11, 1, 51)]
    assert size < sum(map(len, texts)) / 4


def test_leak_classes_do_not_shuffle_words_or_candidates(spark, moved, tmp_path):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(2000)]
    texts = [" ".join(rng.sample(words, 150)) for _ in range(400)]
    rows = [(i, t, f"src{i % 20}") for i, t in enumerate(texts)] + [(400, texts[0] + " more", "src19"), (401, texts[1], "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    found, size = moved(corpus.leak_classes, str(tmp_path))
    assert len(found) == 402 and {r.doc_id for r in found if r.forestalled} == {400} and {r.doc_id for r in found if r.n_links} == {0, 400}
    # counts by bucket of the index add some hundred kB, whatever the table's size
    assert size < 2 * sum(map(len, texts))


def test_schema_check_parses_json_once(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "integer", "minimum": 3, "maximum": 5}}}}}}
    found = governance.violations(spark.createDataFrame([(1, '{"a":[{"b":2},{"b":"x"},7]}'), (2, "{")], "id long, j string"), "id", "j", schema)
    assert sorted((r.id, r.path, r.rule) for r in found.collect()) == [(1, "$.a[0].b", "minimum"), (1, "$.a[1].b", "type"), (1, "$.a[2]", "type"), (2, "$", "type")]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
