import os

import pytest
from pyspark.sql import functions as F

from termloom.operators.preprocess import preprocess
from termloom.sources import lineage, sinks, tables


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_raw_rows_need_their_fields(spark, tmp_path):
    at = put(tmp_path / "c.tsv", "q1\thow to\tD1\tu\nbad\tline\nq2\tx\tD2\tu\textra\n\xff\n")
    assert rows(tables.raw_clicks(spark, at)) == [("q1", "how to", "D1", "u"), ("q2", "x", "D2", "u\textra")]
    assert rows(tables.clicked_ids(spark, at)) == [("D1",), ("D2",)]
    assert rows(tables.corpus_lines(spark, at))[0] == ("bad", "bad\tline")
    lines = tables.text_lines(spark, at)
    good, seen = tables.counted(lines, F.size(F.split("value", "\t", 4)) == 4, "clicks")
    assert good.count() == 2 and seen.get == {"n_good": 2, "n_bad": 2}


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    at = put(tmp_path / "x.tsv", b"D1\tu\tt\xff\tb\n")
    assert rows(tables.raw_corpus(spark, at)) == [("D1", "u", "t�", "b")]


def test_padded_rows_keep_short_and_drop_long(spark, tmp_path):
    at = put(tmp_path / "a.tsv", 'D1\tt "x\tb\nD2\tt\nD3\ta\tb\tc\nnan\tt\tb\n')
    assert rows(tables.padded_rows(spark, at, tables.ANALYZED_CORPUS)) == [("D1", 't "x', "b"), ("D2", "t", None), ("nan", "t", "b")]
    assert (None, "t", "b") in rows(tables.padded_rows(spark, at, tables.ANALYZED_CORPUS, ("nan", "null")))
    at = put(tmp_path / "q.tsv", 'q1\t"a b"\tD1\n')
    assert rows(tables.quoted_rows(spark, at, tables.ANALYZED_CLICKS)) == [("q1", "a b", "D1")]


def test_click_graph_rows_reject_other_shapes(spark, tmp_path):
    at = put(tmp_path / "g.tsv", "q1\t a \tD1\nq2\tb\tD2 \tu\n")
    assert rows(tables.click_graph_rows(spark, at)) == [("q1", "a", "D1"), ("q2", "b", "D2")]
    assert tables.click_graph_rows(spark, at, most=1).count() == 1
    bad = put(tmp_path / "h.tsv", "q1\ta\n")
    with pytest.raises(Exception, match="neither three nor four"):
        tables.click_graph_rows(spark, bad).collect()
    assert rows(tables.train_ids(spark, at)) == [("q1",), ("q2",)]


def test_json_corpus_names_and_empties(spark, tmp_path):
    at = put(tmp_path / "c.jsonl", '{"id": "D1", "contents": "a b"}\n\n{"docid": "D2", "text": "é"}\n{"id": "D3", "contents": " "}\n')
    assert rows(tables.json_corpus(spark, at)) == [("D1", "a b"), ("D2", "é")]
    sinks.json_corpus(tables.json_corpus(spark, at), str(tmp_path / "out"))
    assert rows(tables.json_corpus(spark, str(tmp_path / "out"))) == [("D1", "a b"), ("D2", "é")]
    got = spark.createDataFrame([('{"contents": "x"}',), ("plain",), (None,)], "raw string").select(tables.stored_contents(F.col("raw")))
    assert [r[0] for r in got.collect()] == ["x", "plain", ""]


def test_weights_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("D1", "a", 0.123456789012), ("D2", "b", 1e-12)], "docid string, term string, probability double")
    sinks.weights(df, str(tmp_path / "w"))
    assert rows(tables.weight_rows(spark, str(tmp_path / "w"))) == [("D1", "a", 0.123456789), ("D2", "b", 0.0)]
    sinks.weights(df, str(tmp_path / "p"), 8, placeholder=True)
    assert rows(tables.weight_rows(spark, str(tmp_path / "p"))) == [("D1", "a", 0.12345679), ("D2", "b", 0.0)]
    at = put(tmp_path / "odd.tsv", "traversal_idx\tdoc_id\tterm\tprobability\n3\tD1\ta\t0.5\nx\ty\n4\tD2\tb\tnone\n")
    assert rows(tables.weight_rows(spark, at)) == [("D1", "a", 0.5)]


def test_run_files_by_tokenizer(spark, tmp_path):
    for name in ("cg_symbol_a1", "baseline_alphanum"):
        put(tmp_path / f"results_test_{name}.tsv", "qid\tquery\tdocno\trank\tscore\tquery_toks\nq1\tx\tD1\t1\t2.5\t{}\n")
    got = tables.run_files(spark, str(tmp_path / "results_test_*.tsv"), "symbol")
    assert rows(got) == [("cg_symbol_a1", "q1", "x", "D1", 1, 2.5)]


def test_writers_read_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "v1"), ("a", 2, "v2")], "term string, tf int, variant string")
    sinks.index(df, str(tmp_path / "i"), ("variant",))
    assert rows(spark.read.parquet(str(tmp_path / "i")).select("variant", "term", "tf")) == [("v1", "b", 1), ("v2", "a", 2)]
    sinks.split_ids(spark.createDataFrame([("q2",), ("q1",)], "qid string"), str(tmp_path / "s"))
    assert rows(tables.split_ids(spark, str(tmp_path / "s"))) == [("q1",), ("q2",)]
    sinks.lines(spark.createDataFrame([("a\tb",)], "value string"), str(tmp_path / "l"))
    assert rows(tables.text_lines(spark, str(tmp_path / "l"))) == [("a\tb",)]
    sinks.sorted_weights(spark.createDataFrame([(1, "D2", "x", 0.5), (0, "D1", "y", 0.1)], "traversal_idx long, docid string, term string, probability double"), str(tmp_path / "t"))
    assert rows(tables.weight_rows(spark, str(tmp_path / "t"))) == [("D1", "y", 0.1), ("D2", "x", 0.5)]
    files = sorted((tmp_path / "t").glob("part-*"))
    assert [x.split("\t")[0] for f in files for x in f.read_text().splitlines() if not x.startswith("traversal")] == ["0", "1"]
    found = spark.createDataFrame([("cg_symbol", "q1", "a b", "D1", 1, 2.5), ("base_alphanum", "q1", "a b", "D2", 1, 0.5)], "variant string, qid string, query string, docid string, rank int, score double")
    sinks.runs(found, str(tmp_path / "r"))
    assert rows(tables.stored_runs(spark, str(tmp_path / "r"))) == sorted(rows(found)) and rows(tables.stored_runs(spark, str(tmp_path / "r"), "symbol")) == [("cg_symbol", "q1", "a b", "D1", 1, 2.5)]
    judged = spark.createDataFrame([("q1", "a b", "D1", "test"), ("q2", "c", "D2", "train")], "qid string, query string, docid string, split string")
    sinks.judgements(judged, str(tmp_path / "j"))
    assert rows(tables.stored_judgements(spark, str(tmp_path / "j"))) == [("test", "q1", "a b", "D1"), ("train", "q2", "c", "D2")]
    sinks.results(df, str(tmp_path / "e"))
    assert rows(spark.read.csv(str(tmp_path / "e"), sep="\t", header=True, schema=df.schema)) == rows(df) and len(list((tmp_path / "e").glob("part-*"))) == 1
    sinks.tab_rows(spark.createDataFrame([("D1", "", 'a "b', None)], "a string, b string, c string, d string"), str(tmp_path / "tab"))
    assert [f.read_text() for f in (tmp_path / "tab").glob("part-*") if f.stat().st_size] == ['D1\t\ta "b\t\n']


def test_ids_are_stripped_of_any_white_space(spark, tmp_path):
    at = put(tmp_path / "ids", "\u3000q1\u00a0\tx\n \t\n\x1fq2\n")
    assert rows(tables.train_ids(spark, at)) == [("q1",), ("q2",)]
    assert rows(tables.split_ids(spark, put(tmp_path / "split", "\u2003q1 \n\u3000\n"))) == [("q1",)]


def test_fetched_documents(spark):
    stored = spark.createDataFrame([("D1", '{"contents": "x"}'), ("D2", "plain")], "docid string, raw string")
    ids = spark.createDataFrame([("D1",), ("D2",), ("D3",)], "docid string")
    assert rows(tables.fetched(ids, stored)) == [("D1", "x"), ("D2", "plain"), ("D3", "")]


def test_preprocess(spark, tmp_path):
    log = put(tmp_path / "log", "q1\tThe Running dogs\tD1\tu\nq2\tthe of\tD1\tu\nbad\tline\nq3\tC++ the.\tD2\tu\textra\nq4\tThe Running dogs\tD3\tu\n")
    out = str(tmp_path / "out")
    assert preprocess(spark, "clicks", "symbol", log, out) == (3, 2)
    assert rows(tables.padded_rows(spark, out, tables.ANALYZED_CLICKS)) == [("q1", "run dog", "D1"), ("q3", "c++ the.", "D2"), ("q4", "run dog", "D3")]
    docs = put(tmp_path / "docs", "D1\tu\tThe Dogs\tRunning\tfar\nD1\tu\t\tthe\nbad\n")
    assert preprocess(spark, "corpus", "alphanum", docs, out) == (2, 1)
    assert rows(tables.padded_rows(spark, out, tables.ANALYZED_CORPUS)) == [("D1", "", ""), ("D1", "dog", "run far")]
    assert preprocess(spark, "corpus", "alphanum", docs, out) == (2, 1) and tables.padded_rows(spark, out, tables.ANALYZED_CORPUS).count() == 2
    with pytest.raises(ValueError, match="unknown dataset"):
        preprocess(spark, "other", "symbol", docs, out)
    with pytest.raises(ValueError, match="unknown tokenizer"):
        preprocess(spark, "corpus", "other", docs, out)


def test_written_tables_are_removed(spark):
    lineage.clean(spark)
    kept = lineage.written(spark.range(5), "kept")
    assert kept.count() == 5 and len(kept.inputFiles()) > 0
    where = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(where) and lineage.clean(spark) == 1 and not os.path.exists(where) and lineage.clean(spark) == 0
