"""Line dedup against a plain version, and its runs."""

import re
from collections import Counter

import pytest
from cases import EDGE_TEXTS

from siltworks.llm.line_dedup import LineRuns, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_force(rows, before=()):
    """Kept rows as a multiset; ``before`` are documents of earlier calls."""
    first, earlier = {}, {key_of(line) for _, text in before for line in (text or "").split("\n")}
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else ():
            key = key_of(line)
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = lambda key: i is not None and len(key) >= 10 and (key in earlier or first[key] < i)  # noqa: E731, B023
        kept = [line for line in lines if not gone(key_of(line))]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def found(df, **options):
    return Counter(map(tuple, dedup_lines(df, **options).collect()))


ROWS = [
    (5, "A shared line here\nshort\n\n  a SHARED line here\t"),
    (3, "a shared line here\r\nonly in three, long enough"),
    (3, "A Shared Line Here\nsecond row of one id, long enough"),
    (9, "short\nonly in three, long enough\nonly in three, long enough\ntail\n"),
    (9, "short\nonly in three, long enough\nonly in three, long enough\ntail\n"),
    (2, "ÄÖÜ ÄÖÜ ÄÖÜ nothing lowered\n123456789\n1234567890"),
    (8, "äöü äöü äöü nothing lowered\n123456789\n 1234567890\x0b"),
    (7, "ÄÖÜ ÄÖÜ ÄÖÜ NOTHING lowered\n\xa01234567890"),
    (None, "a shared line here\na line of nobody, long enough"),
    (None, "a line of nobody, long enough"),
    (11, None),
    (12, ""),
    (-4, "tail\nshort\n1234567890"),
    (13, "a shared line here"),
    (14, "\n" * 3000 + "a shared line here\n" * 3000 + "東京タワー東京タワー東\n"),
    (15, "東京タワー東京タワー東\n東京タワー東京タワ\n"),
    (16, "東京タワー東京タワ"),
]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_equal_brute_force(spark, batches):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ROWS], "doc_id long, text string, h1 string, first int, pos int").repartition(3)
    assert found(df, batches=batches, fanout=2) == brute_force(ROWS)


def test_lines_of_documents_and_edge_cases(edge_docs, no_docs, documents):
    assert found(edge_docs) == brute_force(EDGE_TEXTS)
    assert found(documents) == brute_force([(r.doc_id, r.text) for r in documents.collect()])
    assert not found(no_docs)


def test_lines_below_and_at_the_length(spark):
    rows = [(1, "x" * 9 + "\n" + "y" * 10 + "\n" + "é" * 9), (2, "x" * 9 + "\n" + "y" * 10 + "\n" + "é" * 9)]
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[2] == "x" * 9 + "\n" + "é" * 9


def test_a_line_in_a_third_of_all_rows(spark):
    rows = [(i, f"one line that many hold\nown line number {i}") for i in range(900)] + [(i, f"another own line {i}") for i in range(900, 2000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == brute_force(rows)


def test_runs_are_compacted_by_level(spark):
    runs = LineRuns(spark, fanout=2, buckets=4)
    documents = [[(10 * b + i, f"line {(b * i) % 7} of everyone\nline of batch {b} only") for i in range(5)] for b in range(5)]
    before = []
    for b, rows in enumerate(documents):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(df, batches=1, runs=runs) == brute_force(rows, before)
        before += rows
        # The runs of the levels are the binary digits of the number of batches.
        assert [len(level) for level in runs.levels] == [(b + 1) >> d & 1 for d in range((b + 1).bit_length())]
    held = [(r.h1, r.h2) for run in runs.runs() for r in run.collect()]
    assert len(held) == len(set(held)) == len({key_of(line) for _, t in before for line in t.split("\n")})
    again = LineRuns(spark, fanout=2, buckets=4, levels=runs.levels)
    assert found(spark.createDataFrame(before, "doc_id long, text string"), batches=1, runs=again) == brute_force(before, before)
    again.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_runs_meet_a_batch_without_being_shuffled(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs = LineRuns(spark, buckets=4)
        keys = spark.range(50).selectExpr("id as h1", "id as h2", "id as first")
        runs.add(keys)
        fresh = spark.range(40, 60).selectExpr("id as h1", "id as h2", "id as first").groupBy("h1", "h2").agg({"first": "min"})
        text = plan(runs.unseen(fresh))
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "SortMergeJoin" in text
        assert runs.unseen(fresh).count() == 10
        runs.forget()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
