"""Each stage of the pipeline on its own input."""

from collections import Counter

import corpus_pipeline as p
from millrace.session import settle, table

from .test_llm import DATA, brute_lines, brute_ngrams, check_packing, empty, odd_docs


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    kept = settle(p.identify_language(spark, docs, DATA))
    assert kept.columns == list(p.COLUMNS) and kept.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lined = settle(p.dedup_lines(spark, kept, DATA))
    want = {k: t for k, t in brute_lines(rows).items() if t.strip() or not dict(rows)[k].strip()}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    joined = settle(p.join_near_duplicates(spark, lined, DATA))
    groups = brute_ngrams([(r.doc_id, r.text) for r in lined.collect()], 5, 80)
    assert sorted(r.doc_id for r in joined.collect()) == sorted({root for _, root in groups.values()})
    mixed = settle(p.mix_sources(spark, joined, DATA))
    assert mixed.columns == list(p.COLUMNS)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times.values()) <= {1, 2} and set(times) <= {r.doc_id for r in joined.collect()}
    packed = p.pack_sequences(spark, mixed, DATA).collect()
    check_packing(packed, 1024)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times


def test_odd_and_empty_inputs(spark):
    for _, stage in p.STAGES:
        assert stage(spark, empty(spark), DATA).count() == 0
        stage(spark, odd_docs(spark), DATA).count()


def test_one_of_equal_rows_stays(spark):
    out = p.join_near_duplicates(spark, odd_docs(spark), DATA).collect()
    assert Counter(r.doc_id for r in out if r.text and r.text.startswith("same")) == {4: 1}
