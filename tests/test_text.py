import pytest
from pyspark.sql import functions as F

from kelpline.functions import geometry, noise, section, text, tokens


def one(spark, f, *values):
    cols = [F.lit(v) for v in values]
    return spark.range(1).select(f(*cols).alias("x")).first().x


@pytest.mark.parametrize(
    ("s", "want"),
    [("ｶﾞﾑ", "ガム"), ("Salt　 Mix", "saltmix"), ("塩・こしょう", "塩こしょう"), ("馬鈴薯でんぷん", "馬鈴薯澱粉"), ("、。", ""), (None, None), ("", "")],
)
def test_normalized(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(text.normalized(F.col("s")).alias("x")).first().x == want


@pytest.mark.parametrize(("s", "want"), [("e-508a", "E508A"), ("E 518", "E518"), ("508", "E508"), ("", None), (None, None)])
def test_norm_code(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(text.norm_code(F.col("s")).alias("x")).first().x == want


def test_finding_token(spark):
    r = one(spark, text.finding_token, "a (b)=c=halal(ing-1)")
    assert (r.raw, r.status, r.entry_id) == ("a (b)=c", "halal", "ing-1")
    assert one(spark, text.finding_token, "nothing") is None


def test_core_and_flat(spark):
    assert one(spark, text.core_form, "ゲル（大豆）") == "ゲル"
    assert one(spark, text.core_form, "（大豆）") == "（大豆）"
    assert one(spark, text.flat_form, "ゲル（大豆）") == "ゲル大豆"


def extract(spark, t):
    return section.sections(spark.createDataFrame([(t,)], "text string"), "text").first().section


def test_section_forward(spark):
    assert extract(spark, "名称 x\n原材料名 小麦、砂\n糖、塩\n賞味期限 2025") == "小麦、砂糖、塩"
    assert extract(spark, "no header here") == "no header here"
    assert extract(spark, None) is None


def test_section_absorbs_what_stands_before(spark):
    assert extract(spark, "名称：菓子\n小麦粉、砂糖\n原材料名 塩、油\n内容量 5g").startswith("小麦粉、砂糖、塩、油")


def test_section_mends_first_item(spark):
    assert extract(spark, "有機 大豆の品\n原材料名 大豆、塩\n内容量 5g") == "有機大豆、塩"


def test_merged_lines(spark):
    assert one(spark, lambda: section.merged_lines(F.array(F.lit("a b\nc"), F.lit("ab\n\nd"))),) == "a b\nc\nd"


def test_tiles(spark):
    r = one(spark, geometry.tiles, 1600, 200)
    assert [(t.x, t.width) for t in r] == [(0, 800), (700, 800), (1400, 200)]
    assert [t.x for t in one(spark, geometry.tiles, 500, 200)] == [0]


def test_crop_stops_at_the_next_part(spark):
    lines = [("名称 x", 0), ("原材料名 小麦", 100), ("塩、油", 140), ("内容量 5g", 180)]
    df = spark.createDataFrame([([(t, y, 30, 940, 40) for t, y in lines],)], "l array<struct<text:string,top:int,left:int,width:int,height:int>>")
    r = df.select(geometry.list_crop(F.col("l"), F.lit(1000), F.lit(2000)).alias("r")).first().r
    assert (r.y, r.height) == (76, 128)


def test_crop_grows_up_and_ignores_words_inside_lines(spark):
    def crop(lines):
        df = spark.createDataFrame([([(t, y, 30, 940, 40) for t, y in lines],)], "l array<struct<text:string,top:int,left:int,width:int,height:int>>")
        return df.select(geometry.list_crop(F.col("l"), F.lit(1000), F.lit(2000)).alias("r")).first().r

    r = crop([("名称 x", 0), ("小麦、砂糖、", 60), ("原材料名", 100), ("塩、植物性たんぱく質、保存料", 140), ("保存方法 冷暗所", 180)])
    assert (r.x, r.y, r.width, r.height) == (30, 36, 940, 168)
    assert crop([("小麦、塩", 0)]) is None and crop([("原材料名 塩", 0), ("", 10)]).height == 88
    assert crop([("原材料名 塩", 40 * i) for i in range(1)] + [("塩、", 40 * i) for i in range(1, 60)]).height == 27 * 40 + 48


def test_candidates_named_and_parts(spark):
    got = one(spark, tokens.candidates, "着色色素（クチナシ、ベニ）、sugar cane、│塩")
    assert got[:2] == ["クチナシ、ベニ", "着色色素クチナシ、ベニ"]
    assert "sugar cane" in got and "sugar" in got and "塩" in got


def test_candidate_rows_keep_first(spark):
    df = spark.createDataFrame([(1, "Salt、salt、pepper"), (2, None)], "id int, s string")
    assert [(r.id, r.term, r.raw) for r in tokens.candidate_rows(df, "id", "s").orderBy("ord").collect()] == [(1, "salt", "Salt"), (1, "pepper", "pepper")]


def test_bigrams_do_not_overlap(spark):
    assert one(spark, tokens.chunk_bigrams, "abcde") == ["ab", "cd", "e"]
    assert one(spark, tokens.chunk_bigrams, "") == []
    assert one(spark, tokens.sliding, "abcd", 3) == ["abc", "bcd"]
    assert one(spark, tokens.sliding, "ab", 3) == []


@pytest.mark.parametrize(
    ("t", "want"),
    [("", True), ("電子版", True), ("500kcal", True), ("salt", False), ("小麦大豆を含む", True), ("豚肉を含む", False), ("豚肉は使用していません", True), ("豚と豚肉は使用していません", False), ("12345", True)],
)
def test_noise(spark, t, want):
    assert one(spark, noise.is_noise, t) is want


def test_weighted_distances_of_many_pairs():
    import random

    from kelpline.functions.distance import costs, weighted_distance, weighted_distances

    rng, table = random.Random(5), costs()
    words = ["".join(rng.choice("アァシツabカガ力ロ口x") for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))) for _ in range(400)]
    a, b = words[:200], words[200:]
    assert weighted_distances(a, b, table).tolist() == pytest.approx([weighted_distance(x, y, table) for x, y in zip(a, b, strict=True)])
    assert weighted_distances(["abc", ""], ["abd", "x"], {}).tolist() == [1.0, 1.0] and len(weighted_distances([], [], table)) == 0


def test_weighted_similarity_of_nulls(spark):
    from kelpline.functions.distance import weighted_similarity

    df = spark.createDataFrame([("アイ", "ァイ"), (None, "a"), ("", ""), ("a", None)], "a string, b string")
    assert [r.s for r in df.select(weighted_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.875, None, 1.0, None]
