"""The registered queries on the smallest tables, and the pipeline against plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import compare
import corpus_pipeline
import pytest
from conftest_llm import EDGES
from test_simhash import slow_components, slow_fingerprint

from tallyspark.llm import decontam, pieces, pii, toxicity
from tallyspark.llm.common import table
from tallyspark.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": {"doc_id", "item_id"},
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op3_sample_pieces": {"doc_id", "sample", "ids", "inclusion"},
    "op4_divergence": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op6_html": {"page_id", "url", "text", "n_chars"},
    "op7_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op8_compression": {"doc_id", "held_out", "score", "predicted"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_substrings": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op11_audit": {
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    },
    "op12_tokens": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op13_fim": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
}


def test_names():
    assert set(llm_queries()) == set(COLUMNS) > set(llm_oracles())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "sentencepiece",
    ]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    rows = llm_queries()[name](spark, SF).collect()
    assert set(rows[0].asDict()) >= COLUMNS[name]
    if name == "op11_audit":
        assert len(rows) == 600 * table(spark, SF, "documents").select("lang").distinct().count()
    elif name not in ("op1_decontaminate", "op3_sample_pieces"):
        assert len(rows) == table(spark, SF, "pages" if name == "op6_html" else "documents").count()


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    assert compare.differences(llm_queries()[name](spark, SF), compare.connect(SF), llm_oracles()[name]) is None


def test_held_out_accuracy(spark):
    """Documents whose labels were not learnt from, at the size where there are enough of them."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    for name, label, least in (("op8_compression", "quality", 0.93), ("op9_toxicity", "toxic", 0.88)):
        rows = [r for r in llm_queries()[name](spark, sf).collect() if r.held_out and r.doc_id in labels]
        hits = [r.predicted == labels[r.doc_id][label] for r in rows]
        assert len(hits) > 60 and sum(hits) / len(hits) > least, name


def test_pipeline_against_plain_stages(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    net = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = toxicity.score_texts(net, [t for _, t in docs])
    docs = sorted(d for d, s in zip(docs, scores, strict=True) if s < 0.5)
    groups = slow_components([(i, slow_fingerprint(t)) for i, t in docs])
    docs = [d for d, g in zip(docs, groups, strict=True) if d[0] == g]
    items = [decontam.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    held = lambda t: any(decontam.best_end(m, t)[0] <= decontam.budget(len(m)) for m in items)
    docs = [(i, t) for i, t in docs if not held(decontam.normalise(t))]
    chain, vocab = pii.learn(), pieces.Vocabulary.load()
    want = {i: pii.redacted(t, pii.find_spans(chain, [t])[0][1]) for i, t in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    assert all(vocab.decode(r.ids) == want[r.doc_id] for r in got)
    assert all(n == 2 for n in Counter(r.doc_id for r in got).values())


def test_stages_take_any_rows_and_keep_the_columns(spark, frame):
    far = 10_000_000  # ids without a label
    docs = frame([(None if i is None else i + far, t) for i, t in EDGES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert {r.doc_id for r in out.collect()} >= {None, *(far + i for i in (101, 104, 105, 106, 107, 108))}, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > len(EDGES)
