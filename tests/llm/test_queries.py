"""Registered queries against SQL, and the pipeline stage by stage."""

import compare
import public_tokenizers as P
import pytest
from cases import EDGE_TEXTS

import __spark_entry__ as entry_points
import corpus_pipeline
from siltworks.llm.quality_rules import quality_rules
from siltworks.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered_once():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry_points.queries().keys() >= QUERIES.keys() and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    names, found = compare.spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = compare.duck_rows(compare.connect(sf_dir), ORACLES[name])
    assert names == expected_names
    assert found == expected


def test_pipeline_stages(spark, sf_dir, documents):
    from test_joins import brute_force

    docs, after = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.parked(stage(spark, docs, sf_dir), "stage")
        after[name] = (before, docs)
    for name in ("quality rules", "language ID", "n-gram Jaccard join"):
        before, kept = after[name]
        assert kept.columns == documents.columns
        assert kept.exceptAll(before).count() == 0
    before, kept = after["quality rules"]
    verdicts = quality_rules(before, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in verdicts.filter("kept").collect()}
    before, kept = after["n-gram Jaccard join"]
    found = brute_force([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, component) in found.items() if i == component}
    before, packed = after["packing"]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_of_edge_cases_and_no_rows(spark, sf_dir, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.parked(stage(spark, docs, sf_dir), "stage")
        assert docs.count() >= 0
    kept = corpus_pipeline.join_stage(spark, edge_docs, sf_dir).collect()
    # Ids 16 comes twice, as exact copies: one row stays.
    expected = [*(i for i, _ in EDGE_TEXTS if i not in (5, 7, 9, 10, 16, 19)), 16]
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, expected))


def test_pipeline_judges_rows_and_not_ids(spark, sf_dir):
    prose = " ".join(f"the quick brown fox number {w} jumps over a lazy dog near the river" for w in ("one", "two", "three", "four", "five", "six"))
    other = "A wholly different story about ships, harbours and the sea. " * 2 + "It has nothing to do with foxes at all."
    rows = [(None, prose), (None, "x"), (None, prose), (7, prose), (7, prose), (7, "x"), (8, other), (8, None), (None, other), (None, "words of nobody, in one row")]
    docs = spark.createDataFrame([(i, t, "en", "src", 1, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int")
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert "x" not in {r.text for r in kept.collect()} and None not in {r.text for r in kept.collect()}
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.join_stage(spark, docs, sf_dir).collect()), key=str)
    assert found == sorted([(7, prose), (7, "x"), (8, other), (8, None), (None, "words of nobody, in one row")], key=str)
