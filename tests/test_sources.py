import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodeloom.operators import aspects, models
from lodeloom.plans import catalogue
from lodeloom.sources import files, sinks
from lodeloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_csv_is_text_without_nulls_or_mark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿idx,language,subject\n007,en,"two\nlines, ""quoted"""\n8,de,\n9,NaN,none\n', encoding="utf-8")
    rows = files.read_table(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("007", "en", 'two\nlines, "quoted"'), ("8", "de", ""), ("9", "NaN", "none")]
    assert files.read_table(spark, str(path), ["subject", "idx", "subject"]).columns == ["subject", "idx"]
    with pytest.raises(ValueError, match="lacks"):
        files.read_table(spark, str(path), ["body"])


def test_csv_round_trip_with_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc'), ("2", "")], "idx string, x string")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/o", bom=True)
    assert next((tmp_path / "o").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf")
    back = files.read_table(spark, f"{tmp_path}/o")
    assert back.columns == ["idx", "x"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"idx": "1", "n": 2}\n\n{"idx": \n{"idx": "3"}\n')
    schema = "idx string, n int"
    assert sorted(r["idx"] for r in files.read_jsonl(spark, str(path), schema, strict=False).collect()) == ["1", "3"]
    assert files.corrupt_lines(spark, str(path), schema).first()["line"] == '{"idx": '
    with pytest.raises(PySparkException):
        files.read_jsonl(spark, str(path), schema).collect()


def test_jsonl_keeps_order_nulls_and_letters(spark, tmp_path):
    df = spark.createDataFrame([("ü", None)], "b string, a string").coalesce(1)
    sinks.write_jsonl(df, f"{tmp_path}/j", ["a", "b"])
    assert next((tmp_path / "j").glob("part-*")).read_text(encoding="utf-8") == '{"a":null,"b":"ü"}\n'


def test_json_array_and_excel(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert sorted(r["x"] for r in files.read_json_array(spark, f"{tmp_path}/a.json").collect()) == [1, 2]
    pytest.importorskip("pandas")
    try:
        import openpyxl  # noqa: F401
    except ModuleNotFoundError:
        with pytest.raises(RuntimeError, match="openpyxl"):
            files.read_table(spark, "x.xlsx")


def test_choose_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Language,subject\nen,x\nfr,y\n")
    (tmp_path / "b.csv").write_text("language,subject\nEN-us,x\nde,y\n")
    (tmp_path / "c.csv").write_text("language,title\nen,x\nen,y\nen,z\n")
    assert files.choose_source(spark, str(tmp_path)).endswith("b.csv")
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.choose_source(spark, f"{tmp_path}/none")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# remark\na: true\nb: 3\nc: 0.5  # half\nd: 'x'\n")
    assert files.read_config(f"{tmp_path}/c.yaml") == {"a": True, "b": 3, "c": 0.5, "d": "x"}
    assert files.merged({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2]}}) == {"a": {"x": 1, "y": [2]}, "b": 2}
    assert files.first_path(None, "", "p", "q") == "p"


def test_write_once_and_digest(spark, tmp_path):
    one, two = spark.range(10).repartition(3), spark.range(11)
    kept, first = sinks.write_once(one, f"{tmp_path}/s")
    assert sinks.write_once(two, f"{tmp_path}/s")[1] == first == sinks.digest(spark.range(9, -1, -1))
    assert kept.count() == 10
    assert sinks.write_once(two, f"{tmp_path}/s", force=True)[1] != first


def test_resume_does_each_key_once(spark, tmp_path):
    work = lambda df: df.select("id", F.lit(1).alias("n"))
    sinks.resume(spark.range(3), f"{tmp_path}/r", "id", work, "id long, n int")
    out = sinks.resume(spark.range(5), f"{tmp_path}/r", "id", work, "id long, n int")
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 4]


def test_report(spark):
    stats = spark.createDataFrame([("rouge", "b", 3, 0.25, 0.1, 0.4), ("rouge", "a", 3, 0.5, None, None)], "metric string, system string, n int, mean double, ci_low double, ci_high double")
    text = sinks.report(stats, "Results", 2)
    assert "| a | 3 | **0.50** | – |\n| b | 3 | 0.25 | 0.10 to 0.40 |" in text


def test_stream_takes_each_file_once(spark, tmp_path):
    go = lambda: incremental.append_new(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: df.filter("id % 2 = 0"))
    spark.range(4).write.parquet(f"{tmp_path}/in")
    go()
    spark.range(4, 8).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6]


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("thanks a lot", "cause here", "I restarted it", ["thank you very much indeed", "too short", "the screen is black now"]), ("the screen is black now", "cause here", "I restarted it", "the screen is black now | cause here")),
        (("the screen is black", "The screen is black.", "it was nice", []), ("the screen is black", "none", "none", "the screen is black")),
        (("vielen Dank", None, "restarted the server", None), ("none", "none", "restarted the server", "none")),
        (("I restarted the box", "", "i restarted the box", ["x"]), ("I restarted the box", "none", "none", "I restarted the box")),
    ],
)
def test_clean_spans(spark, row, want):
    df = spark.createDataFrame([row], "prob_sub string, cause string, action_taken string, s array<string>")
    got = aspects.clean_spans(df, dict.fromkeys(aspects.SPANS, "s")).first()
    assert tuple(got[c] for c in (*aspects.SPANS, "prob_statement")) == want


def test_a_sentence_replaces_one_span_only(spark):
    df = spark.createDataFrame([("thanks", "thanks", "x", ["one two three four", "five six seven eight"])], "prob_sub string, cause string, action_taken string, s array<string>")
    got = aspects.clean_spans(df, dict.fromkeys(aspects.SPANS, "s")).first()
    assert (got["prob_sub"], got["cause"]) == ("one two three four", "five six seven eight")


def test_heads(spark):
    rows = [([float(k == c) + i / 100 for k in range(8)], f"c{c}") for c in range(3) for i in range(20)]
    df = spark.createDataFrame([*rows, ([0.0] * 8, None), ([0.0] * 8, " ")], "v array<double>, y string")
    model, names = models.train_head(df, "v", "y")
    assert names == ["c0", "c1", "c2"]
    out = models.predict_head(df, "v", model, names)
    got = models.evaluate_head(out, "y", "predicted").first()
    assert got["accuracy"] == 1.0 and got["total"] == 60 and got["majority_f1"] == pytest.approx(1 / 6, abs=1e-4)
    with pytest.raises(ValueError, match="two classes"):
        models.train_head(df.filter("y = 'c0'"), "v", "y")
    with pytest.raises(PySparkException):
        models.predict_head(spark.createDataFrame([([1.0],)], "v array<double>"), "v", model, names).collect()


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("Größe ändern",), ("ändern größe",), ("",), (None,)], "t string")
    a, b, c, d = (r["v"] for r in df.select(models.hashed_embedding(F.col("t"), 16).alias("v")).collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and not any(c) and not any(d)


@pytest.mark.parametrize("name", ["span_cleanup", "lr_heads"])
def test_new_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
