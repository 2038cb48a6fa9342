from datetime import datetime

from glyphmill.operators.orphans import Reference, Target, orphan_references, orphan_report

REFS = "id bigint, doc_id bigint, created_at timestamp_ntz, target string"
DOCS = "doc_id bigint, date_added timestamp_ntz, deleted_at timestamp_ntz, id string"


def found(spark, refs, docs, heavy=2000):
    out = orphan_references([Reference("r", spark.createDataFrame(refs, REFS), "doc_id", "docs")], [Target("docs", spark.createDataFrame(docs, DOCS), "doc_id", "date_added", "deleted_at")], heavy)
    return {(r.record_id, r.period, r.reason) for r in out.collect()}


def day(n, month=3):
    return datetime(2025, month, n)


def test_reasons_nulls_repeats_and_hot_keys(spark):
    docs = [(1, day(1), None, "x"), (2, day(1), day(20), "x"), (3, day(20), None, "x"), (4, None, None, None)]
    refs = [(10, 1, day(5), "t"), (11, 2, day(5), "t"), (12, 3, day(5), "t"), (13, 3, day(25), "t"), (14, 9, day(5), "t"), (14, 9, day(5), "t"), (15, None, day(5), "t"), (16, 9, None, "t"), (17, 3, None, "t"), (18, 4, day(5), None)]
    refs += [(100 + k, 7, day(6, 4), "t") for k in range(60)]  # a missing key that holds most rows
    want = {(11, "2025-03", "deleted"), (12, "2025-03", "late"), (14, "2025-03", "missing"), (16, None, "missing")} | {(100 + k, "2025-04", "missing") for k in range(60)}
    assert found(spark, refs, docs) == want
    assert found(spark, refs, docs, heavy=1) == want


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], [(1, day(1), None, "x")]) == set()
    assert found(spark, [(1, 1, day(2), "t")], []) == {(1, "2025-03", "missing")}


def test_report(spark):
    rows = spark.createDataFrame([("a", 1, "2025-01", "late"), ("a", 2, "2025-01", "late")], "table_name string, record_id bigint, period string, reason string")
    assert [tuple(r) for r in orphan_report(rows).collect()] == [("a", "2025-01", "late", 2)]
