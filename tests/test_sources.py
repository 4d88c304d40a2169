import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from kelpline.operators import corpus, search
from kelpline.sources import files
from kelpline.streaming import log_stream


def test_products(spark, tmp_path):
    p = tmp_path / "x.tsv.gz"
    with gzip.open(p, "wt") as f:
        f.write("countries_tags\tcountries_en\tingredients_text\tcategories_tags\nen:japan\tJapan\t\"塩\tx\nen:france\tFrance\tsel\ty\n")
    assert [r.ingredients_text for r in files.products(spark, str(p)).collect()] == ['"塩']


def test_records_of_all_shapes(spark, tmp_path):
    rec = {"file": "a.jpg", "ingredients": [{"raw": "salt", "expected": "halal"}]}
    lines = [json.dumps(rec), json.dumps({"records": [rec, rec]}), json.dumps({"gt": [rec]}), "{broken"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = files.records(spark, str(tmp_path)).collect()
    assert sum(r.file == "a.jpg" for r in rows) == 4
    assert sum(r._corrupt is not None for r in rows) == 1


def test_triples(spark):
    text = ["<c1> a x ;", '  label "Salt" ;', '  label "Other" ;', "  certificate <k1> ;", "  certificate <k2> .", "<c2> a y ;", "  organization <o> ."]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, line string")
    got = {r.subject: (r.label, r.certificate, r.org) for r in files.triples(df).collect()}
    assert got == {"<c1>": ("Salt", "<k2>", None), "<c2>": (None, None, "<o>")}


def test_code_table(spark):
    df = spark.createDataFrame([(1, " 100  Curcumin  x"), (2, "100 Later"), (3, "471a  Fats *"), (4, "text")], "line_no int, line string")
    assert {r.code: (r.name, r.status) for r in files.code_table(df).collect()} == {"E100": ("Curcumin", "listed"), "E471A": ("Fats", "doubtful")}


def test_pinned(spark, tmp_path):
    p = tmp_path / "in"
    p.write_text("abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert files.pinned(spark, str(p), good).count() == 1
    with pytest.raises(Exception, match="changed"):
        files.pinned(spark, str(p), "0" * 64).collect()


def test_images_and_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.jpg").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    f = files.images(spark, str(tmp_path))
    m = spark.createDataFrame([("other/a.jpg", "label", "shop")], "file string, kind string, source string")
    assert [(r.kind, r.source) for r in files.with_manifest(f, m).collect()] == [("label", "shop")]


def test_rotation(spark):
    df = spark.range(100).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 10 == 0, "feedback").alias("rec_type"), F.col("id").cast("string").alias("scanned_at"))
    assert files.rotated(df, 10**9, {"scan": 5, "feedback": 3}).count() == 100
    assert {r["count"] for r in files.rotated(df, 10, {"scan": 5, "feedback": 3}).groupBy("rec_type").count().collect()} == {5, 3}


def test_json_sink(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first().value == '{"a":1}'


def test_search_limits():
    assert [search.limit_of(x) for x in (None, 0, -3, float("nan"), float("inf"), 5.9)] == [30, 30, 30, 30, 30, 5]


def test_weighted_sample_prefers_weight(spark):
    df = spark.createDataFrame([(f"t{i}", 1000 if i < 10 else 1) for i in range(1000)], "t string, w int")
    got = {r.t for r in corpus.weighted_sample(df, "w", 10, 3, "t").collect()}
    assert len(got & {f"t{i}" for i in range(10)}) >= 8
    assert got == {r.t for r in corpus.weighted_sample(df.repartition(7), "w", 10, 3, "t").collect()}


def test_stream_drops_second_deliveries(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/scan_log.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    s = log_stream.delivered_once(log_stream.log_stream(spark, str(tmp_path / "in"), src.schema), "400 days")
    q = s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == src.select("sid").distinct().count()


def test_stream_counts_windows(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/scan_log.parquet")
    src.write.parquet(str(tmp_path / "in"))
    s = log_stream.windowed_counts(log_stream.log_stream(spark, str(tmp_path / "in"), src.schema), late="400 days")
    q = s.writeStream.format("memory").outputMode("complete").queryName("win").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == src.count()


def test_stream_keeps_running_counts(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/scan_log.parquet")
    src.write.parquet(str(tmp_path / "in"))
    s = log_stream.running_misses(log_stream.log_stream(spark, str(tmp_path / "in"), src.schema))
    q = s.writeStream.format("memory").outputMode("update").queryName("miss").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.term: r.n for r in src.select(F.explode("miss").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert {r.term: r.n for r in spark.table("miss").groupBy("term").agg(F.max("n").alias("n")).collect()} == want
