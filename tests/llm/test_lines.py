import hashlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import lines
from termloom.llm.registry import queries


def line_docs(spark):
    common = "This line is long enough to count"
    rows = [(1, f"{common}\nown one\n{common}"), (2, f"  {common.upper()} \t\nshort"), (3, f"x\n{common}\n"), (4, "twice only, but long enough\nz"), (5, "twice only, but long enough"), (6, None), (7, ""), (8, "short\nshort"), (9, "short"), (10, "short")]
    rows += [(3, f"x\n{common}\n"), (None, f"{common}\nnull id"), (11, "É" * 19 + "\n" + "É" * 20), (12, "É" * 20), (13, "é" * 20 + "\n" + "É" * 20), (14, "line that repeats\n" * 4000)]
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, keeper string, n_lines int, h1 int")


def test_lines_against_sql_and_odd_rows(spark):
    df = line_docs(spark)
    for batches in (1, 3):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.text, r.keeper, r.h1) for r in lines.dedup_lines(df, batches=batches, fanout=2).collect() if r.doc_id != 6)
        named = {g[0]: g for g in got}
        assert named[1][1:4] == (3, 2, "own one") and named[2][1:4] == (2, 1, "short") and named[3][1:4] == (3, 0, "x\nThis line is long enough to count\n")
        assert named[4][2] == named[5][2] == named[9][2] == named[14][2] == 0 and named[7][1:4] == (1, 0, "")
        assert named[-1][1:4] == (2, 1, "null id") and named[11][3] == "É" * 19 and named[12][3] == "" and named[13][3] == "é" * 20 + "\n" + "É" * 20
        assert len(got) == 15 and named[1][4:] == ("k", 2)
    assert lines.dedup_lines(df.where(F.lit(False))).count() == 0


def test_runs_compact(spark):
    runs = lines.LineRuns(spark, buckets=4, fanout=2)
    for did in range(6, 0, -1):
        runs.add(spark.createDataFrame([(k, k * 7, did) for k in range(10) if k % did == 0], "h1 long, h2 long, did long"))
    assert [len(level) for level in runs.levels] == [0, 1, 1, 0][: len(runs.levels)]
    got = {r.h1: (r.n_docs, r.keeper) for r in runs.totals().collect()}
    assert got == {k: (sum(k % d == 0 for d in range(1, 7)), max(d for d in range(1, 7) if k % d == 0)) for k in range(10)}


def brute(rows, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, kept text) of rows of (doc_id, text) with distinct ids."""
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(lower)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries()["op5_line_dedup"](spark, sf).collect())
    assert got == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]


def test_runs_go_when_a_job_fails(spark):
    before = {t.name for t in spark.catalog.listTables()}
    broken = line_docs(spark).withColumn("doc_id", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("doc_id")))
    with pytest.raises(Exception, match="lost"):
        lines.dedup_lines(broken).collect()
    runs = lines.LineRuns(spark, buckets=2)
    with pytest.raises(ZeroDivisionError):
        with runs:
            runs.add(spark.createDataFrame([(1, 1, 1)], "h1 long, h2 long, did long"))
            1 / 0
    assert {t.name for t in spark.catalog.listTables()} == before
