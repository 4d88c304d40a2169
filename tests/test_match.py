import random

import pytest
from pyspark.sql import functions as F

from kelpline.functions.distance import costs, weighted_distance
from kelpline.operators import etl, match
from kelpline.operators.evaluate import aligned, greedy_alignment, metrics, outcome, preferred, with_overrides, zipped
from kelpline.operators.hot_join import hot_join
from kelpline.operators.pass_join import near_pairs


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allow(n):
    return 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 7 else 3


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcあ") for _ in range(rng.randint(1, 11)))
    left, right = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    want = {(a, b, lev(a, b)) for a in left for b in right if lev(a, b) <= min(allow(len(a)), allow(len(b)))}
    got = near_pairs(spark.createDataFrame([(x,) for x in [*left, None, ""]], "a string"), spark.createDataFrame([(x,) for x in [*right, None, ""]], "b string"), "a", "b")
    assert {tuple(r) for r in got.collect()} == want


def test_near_pairs_within_a_key(spark):
    a = spark.createDataFrame([(1, "carrot"), (2, "carrot")], "k int, a string")
    b = spark.createDataFrame([(1, "carot")], "k int, b string")
    assert [tuple(r) for r in near_pairs(a, b, "a", "b", ("k",)).collect()] == [(1, "carrot", "carot", 1)]


def test_only_near_pairs_are_made_distinct(spark):
    a, b = (spark.createDataFrame([(x,) for x in ("carrot", "carot", "parrot")], f"{c} string") for c in "ab")
    top = near_pairs(a, b, "a", "b")._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Aggregate" and "edits" in [f.name() for f in list(top.schema().fields())]


def test_looked_up_places_are_never_broadcast(spark):
    a, b = (spark.createDataFrame([(f"carrot{i}",) for i in range(n)], f"{c} string") for c, n in (("a", 300), ("b", 5)))
    near = near_pairs(a, b, "a", "b")
    near.collect()
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def terms(spark):
    rows = [(1, 0, "carrot", "halal"), (2, 0, "parrot", "haram"), (3, 0, "potatoes", "halal"), (4, 0, "potatoes", "syubhat"), (5, 0, "cinnamon", "halal")]
    return spark.createDataFrame([(o, n, t, s, f"e{o}", t) for o, n, t, s in rows], "ord int, alias_no int, term string, status string, id string, alias string")


def test_strictest_entry_stands_for_a_term(terms):
    assert {r.term: r.status for r in match.exact_index(terms).collect()} == {"carrot": "halal", "parrot": "haram", "potatoes": "syubhat", "cinnamon": "halal"}


def test_fuzzy_is_refused_near_a_denied_term(spark, terms):
    t = spark.createDataFrame([("carrots",), ("cinnamom",), ("cinna",), ("zzzzzzzz",)], "term string")
    got = {r.term: r.matched_term for r in match.fuzzy_match(t, terms, weighted=False).collect()}
    assert got == {"cinnamom": "cinnamon"}


def test_fuzzy_is_the_same_from_either_side(spark, terms):
    t = spark.createDataFrame([("carrots",), ("cinnamom",), ("potatos",), ("cinna",), ("zzzzzzzz",)], "term string")
    assert sorted(match.fuzzy_match(t, terms, few_terms=True).collect()) == sorted(match.fuzzy_match(t, terms).collect()) != []


def test_fuzzy_never_gives_a_denied_status(spark, terms):
    t = spark.createDataFrame([("parrots",), ("parrot",)], "term string")
    assert match.fuzzy_match(t, terms, weighted=False).count() == 0


def test_layers(spark, terms):
    catalog = terms.filter("ord = 5").withColumn("term", F.lit("tapioca pearls")).withColumn("id", F.lit("c1"))
    rules = [{"id": "fish", "status": "halal", "patterns": ["fish"]}]
    t = spark.createDataFrame([("carrot",), ("starfish",), ("cinnamom",), ("tapioca pearls",), ("tapioca pearlz",), ("nothing at all",)], "term string")
    got = {r.term: (r.layer, r.kind) for r in match.layered_match(t, terms, catalog, rules).collect()}
    assert got == {"carrot": ("curated", "exact"), "starfish": ("rule", "exact"), "cinnamom": ("curated", "fuzzy"), "tapioca pearls": ("catalog", "exact"), "tapioca pearlz": ("catalog", "fuzzy"), "nothing at all": (None, None)}


def test_collapse(spark):
    f = spark.createDataFrame([(1, 1, "carrot", "halal", 1.0), (1, 2, "carrot", "halal", 0.8), (1, 3, "carrof", None, None), (2, 4, "carrof", None, None)], "label int, ord int, term string, status string, score double")
    assert sorted((r.label, r.ord) for r in match.collapsed(f, "label").collect()) == [(1, 1), (2, 4)]


def test_collapse_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(match, "PART", 300, raising=False)
    rng, c = random.Random(9), costs()
    words = ["".join(rng.choice("カガ力oO0一ーxy") for _ in range(rng.randint(1, 12))) for _ in range(160)]
    rows = [(i % 2, i, t, rng.choice([None, "unknown", "unknown", "unknown", "halal", "haram"]), None) for i, t in enumerate(words)]
    first = {}
    for r in rows:
        first.setdefault((r[0], r[2]), r)
    strong = [r for r in first.values() if r[3] in ("halal", "haram")]
    like = lambda a, b: 1 - weighted_distance(a, b, c) / max(len(a), len(b))
    gone = {r[1] for r in first.values() if r[3] in (None, "unknown") and any(s[0] == r[0] and like(r[2], s[2]) >= (0.5 if len(r[2]) <= 3 else 0.4) for s in strong)}
    want = {r[1] for r in first.values()} - gone
    got = match.collapsed(spark.createDataFrame(rows, "label int, ord int, term string, status string, score double"), "label")
    assert {r.ord for r in got.collect()} == want and gone


def test_collapse_of_large_labels_equals_brute_force(spark, monkeypatch):
    for k, v in {"MANY": 90, "PART": 300, "WEAK": 40, "STRONG": 15}.items():
        monkeypatch.setattr(match, k, v)
    rng, c = random.Random(4), costs()
    words = ["".join(rng.choice("カガ力oO0一ーxyabcd") for _ in range(rng.randint(1, 14))) for _ in range(250)] + ["a" * 70, "a" * 66, "ab" * 40]
    # two labels of many findings, one of few, one without strong findings, and rows without label or term
    rows = [(i % 2 if i < 200 else 2 + i % 2, i, t, None if i >= 200 and i % 2 else rng.choice([None, "unknown", "unknown", "halal"]), None) for i, t in enumerate(words)]
    rows += [(0, 900, None, "halal", None), (None, 901, "xy", "halal", None), (None, 902, "xya", None, None), (0, 903, words[0], rows[0][3], None)]
    like = lambda a, b: 1 - weighted_distance(a, b, c) / max(len(a), len(b))
    first = {}
    for r in rows:
        first.setdefault((r[0], r[2]), r)
    strong = [r for r in first.values() if r[3] == "halal" and None not in r[:3:2]]
    gone = {r[1] for r in first.values() if r[3] != "halal" and any(s[0] == r[0] and like(r[2], s[2]) >= (0.5 if len(r[2]) <= 3 else 0.4) for s in strong)}
    got = match.collapsed(spark.createDataFrame(rows, "label int, ord int, term string, status string, score double"), "label")
    assert got.columns == ["label", "term", "ord", "status", "score"]
    assert sorted(r.ord for r in got.collect()) == sorted({r[1] for r in first.values()} - gone) and gone


def test_collapse_of_a_hot_label_takes_no_time_for_each_pair(spark):
    import time

    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(300)]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(6, 16)))
    rows = [("hot", i, word(), "halal" if i % 2 else None, None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "label string, ord int, term string, status string, score double")
    began = time.time()
    assert 15_000 < match.collapsed(df, "label").count() <= 30_000
    assert time.time() - began < 45


def test_weighted_distance():
    c = costs([("ab", 0.2)])
    assert weighted_distance("xa", "xb", c) == pytest.approx(0.2)
    assert weighted_distance("", "abc", c) == 3
    assert weighted_distance("abc", "c", {}) == 2


def test_greedy_rounds_equal_the_sequential_pass(spark):
    rng = random.Random(7)
    pairs = {(rng.randint(1, 20), rng.randint(1, 20)): rng.choice([0.6, 0.7, 0.8, 1.0]) for _ in range(120)}
    want, lefts, rights = set(), set(), set()
    for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in lefts and b not in rights:
            want.add((a, b))
            lefts.add(a)
            rights.add(b)
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "l int, r int, score double")
    assert {(x.l, x.r) for x in greedy_alignment(df, "l", "r", "score").collect()} == want
    assert greedy_alignment(df.limit(0), "l", "r", "score").count() == 0


def test_greedy_takes_long_ties_to_the_end(spark):
    ties = [(a, 100 + b, 1.0) for a in range(60) for b in range(55)] + [(a, 100 + b, 0.5) for a in range(58, 62) for b in range(50, 58)]
    want, used = set(), set()
    for a, b, _ in sorted(ties, key=lambda x: (-x[2], x[0], x[1])):
        if not {("l", a), ("r", b)} & used:
            want.add((a, b))
            used |= {("l", a), ("r", b)}
    got = [(x.l, x.r) for x in greedy_alignment(spark.createDataFrame(ties, "l int, r int, score double"), "l", "r", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 55


def test_alignment_pairs_repeats_in_order(spark):
    items = spark.createDataFrame([("f", 1, "carrot"), ("f", 2, "carrot"), ("g", 3, "onions")], "file_name string, gt_no int, term string")
    found = spark.createDataFrame([("f", 10, "carrot"), ("f", 11, "carrot"), ("f", 12, "carrot"), ("g", 13, "onionz")], "file_name string, finding_no int, term string")
    assert sorted((r.gt_no, r.finding_no) for r in aligned(items, found).collect()) == [(1, 10), (2, 11), (3, 13)]


def test_metrics_guard_zero_divisions(spark):
    rows = spark.createDataFrame([], "expected string, hazard boolean, status string, matched boolean, file_name string").withColumn("outcome", outcome(F.col("expected"), F.col("status"), F.col("matched")))
    m = metrics(rows).first()
    assert (m["items"], m.hazard_recall, m.accuracy) == (0, 1.0, 0.0)


def test_hot_join_keeps_all_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert hot_join(rows, per, "k", "n", 3000).count() == 3000


def test_arbitration(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "code string, status string")
    o, c, t = mk(("1", "halal"), ("2", "halal"), ("3", "halal")), mk(("2", "halal"), ("3", "haram"), ("4", "halal"), ("5", "halal")), mk(("4", "haram"), ("6", "haram"))
    got = {r.code: (r.status, r.basis) for r in etl.arbitrated(o, c, t, "code", "status").collect()}
    assert got == {"1": ("halal", "official"), "2": ("halal", "cross-source"), "3": ("haram", "conflict"), "4": ("syubhat", "conflict"), "5": ("halal", "single-source"), "6": ("haram", "single-source")}


def test_upsert_is_idempotent(spark):
    cur = spark.createDataFrame([("a", "x", ["1"]), ("b", "y", None)], "id string, basis string, sources array<string>")
    new = spark.createDataFrame([("a", "z", ["2"]), ("c", "n", ["3"])], "id string, basis string, sources array<string>")
    once = etl.upsert(cur, new, "id", ("sources",), ("basis",))
    twice = etl.upsert(once, new, "id", ("sources",), ("basis",))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.id: r.sources for r in once.collect()} == {"a": ["1", "2"], "b": None, "c": ["3"]}


def test_numbered_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert [r._no for r in etl.numbered(df, "v").orderBy("v").collect()] == list(range(1000))


def test_owned_names(spark):
    n = spark.createDataFrame([("E1", "salt"), ("E2", "salt"), ("E2", "e2"), ("E1", "e2"), ("E3", "only")], "code string, name string")
    assert sorted(map(tuple, etl.owned_names(n, "code", "name").collect())) == [("E2", "e2"), ("E3", "only")]


def test_content_version_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert etl.content_version(a).first() == etl.content_version(a.orderBy(F.desc("a"))).first()
    assert etl.content_version(a).first() != etl.content_version(a.limit(1)).first()


def test_repair_pass_prefers_the_expected_status(spark):
    items = spark.createDataFrame([("f", 1, "carrots", "haram"), ("f", 2, "onions", "haram")], "file_name string, gt_no int, term string, expected string")
    found = spark.createDataFrame([("f", 10, "carrots", "halal"), ("f", 11, "carrot", "haram"), ("f", 12, "onions", "haram")], "file_name string, finding_no int, term string, status string")
    a = aligned(items.drop("expected"), found.drop("status"))
    assert sorted((r.gt_no, r.finding_no) for r in a.collect()) == [(1, 10), (2, 12)]
    got = {r.gt_no: (r.finding_no, r.repaired) for r in preferred(items, found, a).collect()}
    assert got == {1: (11, True), 2: (12, False)}
    o = spark.createDataFrame([(2, 10)], "gt_no int, finding_no int")
    assert sorted((r.gt_no, r.finding_no) for r in with_overrides(a, o).collect()) == [(2, 10)]


def test_alignment_scores_all_classes(spark):
    items = [("f", 1, "砂糖（国産）"), ("f", 2, "sweet potato starch"), ("f", 3, "醤油"), ("f", 4, "abcdefghijklmnopqrst"), ("f", 5, "香料（大豆由来）"), ("g", 6, "ab"), ("g", 7, "ab")]
    found = [("f", 10, "砂糖", None), ("f", 11, "sweet potato", None), ("f", 12, "qqqq", "醤油"), ("f", 13, "abcdefgzzzzzopqrst", None), ("f", 14, "大豆由来", None), ("g", 15, "abc", None), ("g", 16, "abd", None)]
    a = aligned(spark.createDataFrame(items, "file_name string, gt_no int, term string"), spark.createDataFrame(found, "file_name string, finding_no int, term string, matched_term string"))
    assert {(r.gt_no, r.finding_no) for r in a.collect()} == {(1, 10), (2, 11), (3, 12), (4, 13), (6, 15), (7, 16)}


def test_zip_needs_equal_counts(spark):
    a = spark.createDataFrame([("x", 1, 5), ("x", 2, 4), ("y", 3, 1)], "s string, a int, t int")
    b = spark.createDataFrame([("x", 10, 1), ("x", 11, 2), ("y", 12, 1), ("y", 13, 2)], "s string, b int, u int")
    assert sorted((r.a, r.b) for r in zipped(a, b, "s", "a", "b", "t", "u").collect()) == [(1, 11), (2, 10)]


def test_short_tokens_and_codes_do_not_match_nearly(spark):
    terms = spark.createDataFrame([("水飴", "a", "halal", 1, 0), ("abcdef", "b", "halal", 2, 0), ("e120bc", "c", "haram", 3, 0), ("e1200b", "d", "halal", 4, 0)], "term string, id string, status string, ord int, alias_no int")
    asked = spark.createDataFrame([("水",), ("水飴x",), ("abcdeg",), ("e120bd",)], "term string")
    got = {r.term: r.id for r in match.fuzzy_match(asked, terms, weighted=False).collect()}
    # a code's own denied entry shadows, though codes are never reached
    assert got == {"abcdeg": "b"}


def test_exact_match_of_hot_terms(spark):
    index = spark.createDataFrame([("salt", "s", "halal", 1, True), ("水", "w", "halal", 2, True)], "term string, id string, status string, ord int, reviewed boolean")
    rows = [(i, "salt") for i in range(3000)] + [(9000, "水"), (9001, "none"), (9002, "none")]
    got = match.exact_match(spark.createDataFrame(rows, "no int, term string"), index)
    assert got.count() == 3003 and got.filter("entry.id = 's'").count() == 3000 and got.filter("entry is null").count() == 3


def test_draws_follow_the_weights(spark):
    from kelpline.operators import corpus

    terms = spark.createDataFrame([(f"t{i}", 1.0) for i in range(5000)] + [("hot", 5000.0), ("none", 0.0)], "term string, w double")
    draws = spark.range(20_000).select("id", corpus.uniform(3, "id").alias("u"))
    got = corpus.drawn(terms, "term", "w", draws, "u")
    counts = {r.term: r["count"] for r in got.groupBy("term").count().collect()}
    assert got.count() == 20_000 and abs(counts["hot"] - 10_000) < 400 and "none" not in counts and len(counts) > 3500
    assert corpus.drawn(terms.limit(0), "term", "w", draws, "u").count() == 0
    labels = spark.range(200).withColumnRenamed("id", "gt_id")
    texts = [r.text.split("、") for r in corpus.synthetic_labels(terms, "term", "w", labels, "gt_id").collect()]
    assert len(texts) == 200 and all(len(set(t)) == len(t) <= 25 for t in texts) and sum("hot" in t for t in texts) == 200


def test_repair_of_risky_items_by_parts(spark):
    items = spark.createDataFrame([("f", 1, "乳化剤（大豆由来）", "syubhat"), ("f", 2, "砂糖", "halal"), ("f", 3, "豚脂", "haram")], "file_name string, gt_no long, term string, expected string")
    found = spark.createDataFrame([("f", 1, "大豆", None, "syubhat"), ("f", 2, "砂糖", None, "unknown"), ("f", 3, "砂糖液", None, "halal"), ("f", 4, "乳化剤", None, "halal"), ("f", 5, "魚油", None, "haram")], "file_name string, finding_no long, term string, matched_term string, status string")
    a = aligned(items.drop("expected"), found.drop("status"))
    got = {r.gt_no: (r.finding_no, r.repaired) for r in preferred(items, found, a).collect()}
    # the compound goes to its part of the expected status; a harmless item isn't repaired; nothing of the pork item is there
    assert got == {1: (1, True), 2: (2, False)}


def test_parts_with_one_edit():
    from kelpline.functions.alignment import is_part

    assert is_part("植物油脂（大豆油）", "大豆油") and is_part("植物油脂（大豆油）", "植物由脂") and not is_part("植物油脂", "魚油") and not is_part("砂糖", "糖")


def test_correlation_by_position_or_likeness(spark):
    from pyspark.sql import functions as F

    from kelpline.functions import tokens
    from kelpline.operators.evaluate import correlated

    a = spark.createDataFrame([("s", 1, 10, "abcd"), ("s", 2, 20, "efgh"), ("t", 3, 10, "abcd"), ("t", 4, 20, "efgh")], "sid string, l int, at int, x string")
    b = spark.createDataFrame([("s", 11, 5, "efgh"), ("s", 12, 6, "abcd"), ("t", 13, 5, "efgh")], "sid string, r int, bt int, y string")
    score = tokens.jaccard(tokens.chunk_bigrams(F.col("x")), tokens.chunk_bigrams(F.col("y")))
    got = sorted((r.l, r.r, r.score) for r in correlated(a, b, "sid", "l", "r", "at", "bt", score).collect())
    assert got == [(1, 11, None), (2, 12, None), (4, 13, 1.0)]
