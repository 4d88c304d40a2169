import random

import pytest
from pyspark.sql import functions as F

from kelpline.llm import encode, mixture

PIECES = ["a", "'", "ll", "s", " ", "  ", "\n", "1", "。", "あ", "é", "日本", "-", "'ve", "𠮷", "́", "　", "½", "<|endoftext|>", "word ", "12345", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def enc():
    return encode.encoder(encode.tokenizer_file())


def test_tree_equals_whole(enc):
    rng = random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        assert enc.encode(s, 3) == enc.leaf(s)


def test_equals_the_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(80)) for _ in range(200)]
    assert [x.ids for x in t.encode_batch(texts, add_special_tokens=False)] == [enc.encode(s, 16) for s in texts]


def test_round_trip(enc):
    s = "Soy 大豆 \n\n 12½ 'll <|endoftext|>"
    assert enc.decode(enc.encode(s, 4), 3).decode() == s


def test_round_trip_of_frames(spark):
    rows = [(1, None), (2, ""), (3, "Soy 大豆 \x1c\x1d \n\n 12½ 'll <|endoftext|>"), (3, "x" * 3000 + " 大豆 " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = encode.decoded(encode.encoded(df)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((k, t or "") for k, t in rows)


def test_join_is_associative(enc):
    a, b, c = "one tw", "o thr", "ee 4'l"
    e = enc.leaf
    left = enc.join(a + b, enc.join(a, e(a), b, e(b)), c, e(c))
    right = enc.join(a, e(a), b + c, enc.join(b, e(b), c, e(c)))
    assert left == right == e(a + b + c)


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "salt", 0), (3, "salt", 0), (4, "ab " * 100_000, 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.encoded(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] and len(got[4]) > 100_000
    assert encode.encoded(df).count() == 5 and encode.encoded(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encode.token_sizes(df).collect()}[4] == len(got[4])


def test_water_filling():
    give = mixture.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, 100)
    assert give["a"] == 10 and give["b"] == pytest.approx(54) and give["c"] == pytest.approx(36)
    assert sum(mixture.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 5}, 100).values()) == 15
    assert mixture.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 0})["a"] == 10
    assert mixture.water_fill({}, {}) == {}


def test_mixture(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 == 9, None).otherwise("other").alias("source"), F.concat(F.lit("salt and water "), F.repeat(F.lit("again "), (F.col("id") % 13).cast("int"))).alias("text"))
    targets = spark.createDataFrame([("small", 0.3, 3), ("big", 0.6, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture.mixture(docs, targets)
    shares = {r.source: r.share for r in report.collect()}
    assert shares["small"] == pytest.approx(1 / 3, abs=0.01) and shares["big"] == pytest.approx(2 / 3, abs=0.01) and shares["absent"] == 0
    assert {r.source: r.m for r in mix.groupBy("source").agg(F.max("copies").alias("m")).collect()}["small"] <= 3
    assert mix.count() == mix.select("doc_id").distinct().count()
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixture.mixture(docs.repartition(5), targets)[0].collect()))
    capped, _ = mixture.mixture(docs, targets, total=10**9)
    assert capped.filter("source = 'small' and copies <> 3").count() == 0
    heavy = spark.createDataFrame([("small", 0.7, 3), ("big", 0.2, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    full, rep = mixture.mixture(docs, heavy, total="all")
    rows = {r.source: r for r in rep.collect()}
    assert rows["small"].clamped and rows["absent"].clamped and rows["small"].tokens == 3 * rows["small"].source_tokens and not rows["big"].clamped
    assert rows["big"].tokens + rows["small"].tokens == pytest.approx(sum(r.source_tokens for r in rows.values()), abs=20)
    # a source that isn't clamped misses its tokens by less than one record
    part, rep = mixture.mixture(docs, targets, total=5000)
    assert all(0 <= r.planned_tokens - r.tokens < 20 for r in rep.collect())
    empty, rep = mixture.mixture(docs.limit(0), targets)
    assert empty.count() == 0 and rep.count() == 3
