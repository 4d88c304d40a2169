import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpline.llm import formatting_copies as fc
from kelpline.llm import term_counts as tc


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice(["a", "b", "", "ü", None, f"t{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 6))] if rng.random() > 0.1 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, terms array<string>").repartition(5)
    occ = Counter(t for _, r in rows for t in r or () if t is not None)
    rec = Counter(t for _, r in rows for t in set(r or ()) if t is not None)
    got = tc.term_counts(df, "terms", ranges=7).collect()
    assert {r.term: (r.n_occurrences, r.n_records) for r in got} == {t: (occ[t], rec[t]) for t in occ}
    assert len({r.term_no for r in got}) == len(got)


def test_weights_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), (None, 3), ("b", 2**40)], "raw string, n long")
    assert {r.term: r.n_occurrences for r in tc.term_counts(df, "raw", "n").collect()} == {"a": 5, "b": 2**40}
    assert tc.term_counts(df.limit(0), "raw", "n").count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 11)], "term string, n_records long")
    total = spark.range(1).select(F.lit(100).cast("long").alias("n"))
    assert {r.term: r.mark for r in tc.marked(counts, "n_records", total, 2, 0.10).collect()} == {"a": "rare", "b": None, "c": "common"}


@pytest.fixture
def records(spark):
    rows = [
        (1, "i1", ["Salt  mix", "塩"], "x"), (2, "i2", ["塩。", "(salt mix)"], "X."), (3, "i3", ["salt mix"], "x"), (4, "i4", None, "x"), (5, "i5", None, "X"), (6, "i6", [], "x"),
        (7, "i7", ["a", "a"], None), (8, "i8", ["A"], None), (9, "i9", [None], ""), (10, "i10", [None], ""), (11, "i11", [""], ""),
    ]
    return spark.createDataFrame(rows, "no long, id string, names array<string>, note string")


def test_copies(records):
    got = {(r.keep_no, r.copy_no, r.copies) for r in fc.copies(records, "no").collect()}
    assert got == {(1, 1, 2), (1, 2, 2), (3, 3, 1), (4, 4, 2), (4, 5, 2), (6, 6, 1), (7, 7, 1), (8, 8, 1), (9, 9, 2), (9, 10, 2), (11, 11, 1)}
    assert fc.copies(records.limit(0), "no").count() == 0
    assert {r.no: r.n_copies for r in fc.collapsed(records.withColumn("n_copies", F.lit("clash")), "no", ("id", "n_copies")).collect()} == {1: 2, 3: 1, 4: 2, 6: 1, 7: 1, 8: 1, 9: 2, 11: 1}


def test_tiny_filter_gives_the_same(records):
    assert fc.copies(records, "no", max_bits=fc.SEGMENT).count() == 11


def test_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("no"), F.lit("x").alias("id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("Hot "))).otherwise(F.array(F.col("id").cast("string"))).alias("names"))
    got = fc.copies(df, "no")
    assert got.count() == 6000 and got.filter("copies = 2000 and keep_no = 0").count() == 2000


def test_slices_give_the_same(spark):
    rows = spark.range(9000).select(F.col("id").alias("no"), F.lit("x").alias("id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("Hot "))).when(F.col("id") < 600, F.array(F.lit("b"), (F.col("id") % 100).cast("string"))).otherwise(F.array(F.col("id").cast("string"))).alias("names"))
    got, want = fc.copies(rows, "no", max_bits=fc.SEGMENT), fc.copies(rows, "no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("copies = 3000").count() == 3000
