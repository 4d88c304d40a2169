import random

import pytest
from pyspark.sql import functions as F

from kelpline.llm import entity_match as em
from kelpline.llm import reference_map as rm
from kelpline.llm import stuffed_pages as sp

PROSE = "The maker says the walnut extract is filtered twice. Keep the pack dry and do not freeze it after opening. "
LIST = "Name: Zisu soup cup\nIngredients: walnut extract, crab powder 12%, barley flakes, honey syrup, soybean paste, kelp oil, potato starch, onion sauce\nNet: 250g\nStorage: Keep the pack dry and do not freeze it after opening.\n"


@pytest.mark.parametrize(
    "text",
    [
        "walnut extract buy " + "walnut extract " * 40, "#walnut #kelp #crab #buy #sale #cheap #soy #oil #bulk #order", "\n".join(f"[oil {i}](http://x.example/{i})" for i in range(20)),
        " » ".join(["drinks", "sweets", "kelp oil", "soup", "bread"] * 6), "\n".join(f"kelp oil {i}g x{i} buy SKU{1000 + i}" for i in range(12)), "Buy kelp oil here. Get kelp oil now. Looking for kelp oil? " * 12,
        PROSE[:60] + "\n" + "kelp oil cheap, kelp oil sale, " * 30,
    ],
)
def test_stuffed(spark, text):
    df = spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in sp.stuffed_pages(df).collect()] == [1]


@pytest.mark.parametrize("text", [None, "", "x", "kelp", PROSE * 5, LIST, PROSE * 3 + "http://a.example/1 #tag #other", "12 34 56", "、、、"])
def test_no_case(spark, text):
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en")], "doc_id long, text string, lang string")
    assert sp.stuffed_pages(df).count() == 0
    assert sp.stuffed_pages(df.limit(0)).count() == 0


def test_long_page(spark):
    df = spark.createDataFrame([(1, "kelp oil cheap " * 60_000, "en", 0)], "doc_id long, text string, lang string, prose int")
    assert sp.stuffed_pages(df).count() == 1


TERMS = [
    (i * 3 + j + 1, f"{b} {f}", bj + fj, br + fr, f"{bo} {fo}")
    for i, (b, bj, br, bo) in enumerate([("carrot", "人参", "にんじん", "ninjin"), ("sweet potato", "甘藷", "かんしょ", "kansho"), ("crab", "蟹", "かに", "kani")])
    for j, (f, fj, fr, fo) in enumerate([("powder", "粉末", "ふんまつ", "funmatsu"), ("starch", "澱粉", "でんぷん", "denpun"), ("dietary fiber", "食物繊維", "しょくもつせんい", "shokumotsuseni")])
]


LEARNT = rm.Learnt(("natural", "有機"), ("s",), (("strch", "starch"), ("pdr", "powder"), ("dietfib", "dietary fiber")))


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("carrot powder", 1), ("Carrot  Powders", 1), ("carot powder", 1), ("powder of carrot", 1), ("starch, carrot", 2), ("carrot_strch", 2), ("carrot pdr (imported)", 1), ("有機人参粉末", 1), ("人参のふんまつ", 1), ("ニンジンデンプン", 2),
        ("ｃａｒｒｏｔ ｐｏｗｄｅｒ 20%", 1), ("natural sweet potato starch *1", 5), ("sweetpotatodiet. fib.", 6), ("kani shokumotsusen", 9), ("carrot cake", -1), ("carrot pie", -1), ("carrot seed", -1), ("", -1), ("20%", -1), ("人参茶", -1), ("crab apple", -1), ("x" * 5000, -1),
    ],
)
def test_mapped(value, want):
    from kelpline.llm.unify import unify_column
    import pyarrow as pa

    assert rm.Index(TERMS, LEARNT).find(unify_column(pa.array([value]))[0][0].as_py())[0] == want


def test_unlisted_combination_means_no_term():
    index = rm.Index([t for t in TERMS if t[1] != "crab starch"], LEARNT)
    assert index.find("crab starch")[0] == -1 and index.find("crabb starch")[0] == -1


def test_osa():
    assert rm.osa("abcd", "acbd", 2) == 1 and rm.osa("", "ab", 2) == 2 and rm.osa("abc", "xyz", 2) == 3 and rm.osa("a", "abcd", 2) == 3


def test_mapping_frames(spark):
    terms = spark.createDataFrame(TERMS, "term_id int, term string, term_ja string, reading string, romaji string")
    v = spark.createDataFrame([("f", 1, 0, "carot powder"), ("f", 2, 0, "carrot powder"), ("f", 3, 0, None), ("f", 4, 0, "zzz"), ("f", 4, 1, "carot powder")], "field string, row_id long, pos int, val string")
    assert sorted(map(tuple, rm.spelled_otherwise(v.filter("val is not null"), terms).collect())) == [("f", 1, 0, 1), ("f", 4, 1, 1)]
    assert {r.val: r.term_id for r in rm.mapped_values(v, terms).collect()} == {"carot powder": 1, "carrot powder": 1, "zzz": None}
    clash = v.withColumn("n", F.lit(1)).withColumn("term_id", F.lit(9)).withColumn("score", F.lit(0))
    assert rm.mapped_rows(clash.filter("val is not null"), terms).count() == 3
    assert rm.mapped_values(v.limit(0), terms).count() == 0
    assert rm.mapped_values(v, terms.limit(0)).filter("term_id is not null").count() == 0


def test_propagation_is_one_to_one(spark):
    e = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 1, 1.0), (3, 3, -4.0)], "l long, r long, w double")
    p = {(r.l, r.r): r.p for r in em.propagate(e).collect()}
    assert p[1, 1] > 0.5 > p[1, 2] and p[3, 3] < 0.1
    # two lesser pairs that go together can outweigh one
    e = spark.createDataFrame([(1, 1, 4.0), (1, 2, 3.0), (2, 1, 3.0)], "l long, r long, w double")
    p = {(r.l, r.r): r.p for r in em.propagate(e).collect()}
    assert p[1, 2] > 0.5 > p[1, 1]
    assert em.propagate(e.limit(0)).count() == 0


def test_propagation_equals_enumeration_on_a_tree(spark):
    from math import exp

    w = {(1, 1): 1.0, (2, 1): 0.5, (2, 2): 1.5}
    total, marg = 0.0, dict.fromkeys(w, 0.0)
    for bits in range(8):
        on = [e for i, e in enumerate(w) if bits >> i & 1]
        if len({a for a, _ in on}) == len(on) == len({b for _, b in on}):
            z = exp(sum(w[e] for e in on))
            total += z
            for e in on:
                marg[e] += z
    got = {(r.l, r.r): r.p for r in em.propagate(spark.createDataFrame([(*k, v) for k, v in w.items()], "l long, r long, w double"), 30, 1e-9).collect()}
    assert got == pytest.approx({k: v / total for k, v in marg.items()}, abs=1e-6)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    origin = {"pebetamu": "ペベタム", "ragukoni": "ラグコニ", "zedowaso": "ゼドワソ", "hizagono": "ヒザゴノ"}
    treat = {"dried": ("kansou", "乾燥"), "twice milled": ("nidobiki", "二度挽き"), "frozen": ("reitou", "冷凍")}
    base = {"cumin": ("kumin", "クミン"), "lotus root": ("renkon", "蓮根"), "shea": ("shia", "シア")}
    form = {"bran": ("nuka", "糠"), "gel": ("geru", "ゲル"), "wax": ("wakkusu", "ワックス")}
    rows, no = [], 0
    for o, oj in origin.items():
        for t, (tr, tj) in treat.items():
            for b, (br, bj) in base.items():
                for f, (fr, fj) in form.items():
                    no += 1
                    rows.append((no, [f"{o} {t} {b} {f}", f"{o} {tr} {br} {fr}", oj + tj + bj + fj]))
    rng.shuffle(rows)
    return rows


def test_matches(spark, world):
    left = [(no, [rng_n[no % 3]], None) for no, rng_n in world] + [(900, None, None), (901, ["salt"], "E1"), (902, [], "E1"), (903, [None], None)]
    right = [(1000 + no, names, f"E-{no}") for no, names in world] + [(2900, ["pepper"], "e1"), (2901, world[0][1][:1], None)]
    ls = spark.createDataFrame(left, "entry_no long, names array<string>, e_number string").withColumn("node", F.lit(0))
    rs = spark.createDataFrame(right, "cat_no long, names array<string>, e_number string")
    got = {(r.entry_no, r.cat_no): r.confidence for r in em.matches(ls, rs, "entry_no", "cat_no").collect()}
    assert set(got) == {(no, 1000 + no) for no, _ in world} | {(world[0][0], 2901)}
    assert min(got.values()) > 0.5
    assert em.matches(ls.limit(0), rs.limit(0), "entry_no", "cat_no").count() == 0


def test_hot_ingredient(spark, world):
    hot = world[0][1]
    left = [(no, names[:1], None) for no, names in world] + [(5000 + i, hot[:1], None) for i in range(60)]
    right = [(10_000 + no, names, None) for no, names in world] + [(20_000 + i, hot[1:2], None) for i in range(50)]
    schema = "{} long, names array<string>, e_number string"
    got = em.matches(spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), "a", "b")
    assert got.count() == len(world) - 1 + 61 * 51 == got.select("a", "b").distinct().count()


def test_slips_are_read(spark, world):
    vocab = em.learn(spark.createDataFrame([(n,) for _, n in world], "names array<string>"))
    r = em.Reader(vocab)
    want = r.read(("pebetamu", "twice", "milled", "lotus", "root", "gel"))
    assert len(want) == 1
    for name in ("pebetamu twice milled lotus rot gel", "twice milled lotus root gel, pebetamu", "PEBETAMU NIDOBIKI RENKON GERU", "ペベタム二度挽き蓮根ゲル", "pebetamutwicemilledlotusrootgel", "pebetamu nido. renkon geru"):
        assert [x for _, x in r.read(em.forms_of(name))] == [want[0][1]]
    assert r.read(em.forms_of("walnut extract")) == [] == r.read(()) == r.read(("x" * 5000,))


def test_messages_decide(spark, world, monkeypatch):
    """A row whose names tell for two ingredients goes to the one that no surer row takes."""
    two = [("pebetamu dried cumin bran", "ragukoni dried cumin bran"), ("zedowaso frozen shea wax", "hizagono frozen shea wax")]
    left = [(no, names, None) for no, names in world if names[0] not in (two[0][1], two[1][1])] + [(5000 + i, list(names), None) for i, names in enumerate(two)]
    right = [(10_000 + no, names, None) for no, names in world]
    ls, rs = spark.createDataFrame(left, "a long, names array<string>, e_number string"), spark.createDataFrame(right, "b long, names array<string>, e_number string")
    number = {names[0]: 10_000 + no for no, names in world}
    got = {(r.a, r.b) for r in em.matches(ls, rs, "a", "b").collect()}
    assert {x for x in got if x[0] >= 5000} == {(5000, number[two[0][1]]), (5001, number[two[1][1]])} and len(got) == len(world)
    monkeypatch.setattr(em, "propagate", lambda e: e.select("l", "r", (1 / (1 + F.exp(-F.col("w")))).alias("p")))
    free = {(r.a, r.b) for r in em.matches(ls, rs, "a", "b").collect()}
    assert len({x for x in free if x[0] >= 5000}) == 4 and got < free


def test_codes_and_fields_count(spark, world):
    left = [(no, names, f"E{no}", "plant" if no % 2 else "animal") for no, names in world]
    right = [(10_000 + no, names, f"e-{no}", "yes" if no % 2 else "no") for no, names in world]
    # two readings of the same strength: the shared code tells
    left.append((5000, ["pebetamu dried cumin bran", "ragukoni dried cumin bran"], "E9001", None))
    right += [(20_000, ["pebetamu dried cumin bran x", "hizagono frozen shea wax", "pebetamu dried cumin bran"], "E9002", None)]
    ls, rs = spark.createDataFrame(left, "a long, names array<string>, e_number string, kind string"), spark.createDataFrame(right, "b long, names array<string>, e_number string, vegan string")
    got = {(r.a, r.b): r.confidence for r in em.matches(ls, rs, "a", "b", (("kind", "vegan"),)).collect()}
    assert {(no, 10_000 + no) for no, _ in world} <= set(got) and min(got.values()) >= 0.5 and max(got.values()) <= 1.0


def test_index_recall_against_brute_force():
    rng = random.Random(8)
    index = rm.Index(TERMS)
    names = [(s, t[0]) for t in TERMS for s in t[1:]]
    hits = total = 0
    for _ in range(600):
        s, t = rng.choice(names)
        if len(s) < 6:
            continue
        i = rng.randrange(1, len(s) - 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :]])
        key = rm.key_of(s)
        dist = sorted((rm.osa(key, k, 2), int(index.term[j])) for j, k in enumerate(index.keys))
        near = {x for d, x in dist if d == dist[0][0]}
        if near == {t} and dist[0][0] <= rm.allowed(len(key), any(c > "㐀" for c in key)):
            total += 1
            hits += index.find(s)[0] == t
    assert total > 200 and hits / total >= 0.97


def test_every_spelling_above_the_threshold_is_checked(data):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{data}/reference_terms.parquet").to_pylist()
    index = rm.Index([tuple(r[c] for c in ("term_id", "term", "term_ja", "reading", "romaji")) for r in rows])
    grams = [{*rm._grams(k)} for k in index.keys]
    for key in ("あつkのうしゅくぶつ", "きそあにだしじる", "kごぬでんぷん", "aこtちょうみりょう", "りくふんまつ", "きbpesuto"):
        mine = rm._grams(key)
        size = sum(index.idf.get(g, index.rare) ** 2 for g in mine) ** 0.5
        want = {}
        for j, k in enumerate(index.keys):
            near = min(rm.allowed(len(key), False), int(index.most[j]))
            cosine = sum(index.idf[g] ** 2 for g in grams[j] & {*mine}) / size / index.norm[j]
            d = rm.osa(key, k, near)
            if cosine >= index.threshold(len(key)) and d <= near:
                t = int(index.term[j])
                want[t] = min(want.get(t, 0), -cosine)
        order = sorted(want.items(), key=lambda x: (x[1], x[0]))
        tie = len(order) > 1 and order[1][1] - order[0][1] < rm.MARGIN
        assert index.find(key)[0] == (-1 if tie or not order else order[0][0])


def test_a_long_sentence_is_a_sentence():
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    english = " ".join(f"{word('abcdefghijklmnop', 6)} {word('qrstuvwxyz', 5)} of the" for _ in range(40)) + " end."
    japanese = "".join(f"{word('昆布水塩鍋火店人酢油米麦粉豆', 4)}を" for _ in range(60)) + "煮ます。"
    assert len(english) > 400 and sp.measure(english)[0] > 0.9 and sp.measure(japanese)[0] > 0.9


def test_a_keyword_run_with_a_stop_is_no_sentence():
    assert sp.measure("buy the kelp oil cheap, kelp oil sale, kelp oil bulk, kelp oil order, kelp oil stock, kelp oil best, kelp oil offer.")[0] == 0.0


def test_remarks_and_short_forms_are_learnt(spark):
    terms = [(i * 2 + j, f"{b} {f}", bj + fj, br + fr, f"{bo} {fo}") for i, (b, bj, br, bo) in enumerate([("carrot", "人参", "にんじん", "ninjin"), ("onion", "玉葱", "たまねぎ", "tamanegi"), ("crab", "蟹", "かに", "kani"), ("squid", "烏賊", "いか", "ika")]) for j, (f, fj, fr, fo) in enumerate([("powder", "粉末", "ふんまつ", "funmatsu"), ("concentrate", "濃縮物", "のうしゅくぶつ", "noushukubutsu")])]
    values = [f"{r} {t[1]}" for t in terms for r in ("raw", "certified")] + [f"{t[1]} blend" for t in terms] + [f"{t[1].split()[0]} {w}" for t in terms for w in ("pwdr", "conc", "cake")] + ["sweet carrot powder", "carrot powder"]
    got = rm.learn(spark.createDataFrame([(v,) for v in values], "val string"), terms)
    assert got == rm.Learnt(("certified", "raw"), ("blend",), (("conc", "concentrate"), ("pwdr", "powder")))
    index = rm.Index(terms, got)
    for value, want in (("certified squid conc", 7), ("raw raw onion powder", 2), ("certifid crab powder blend", 4), ("sweet carrot powder", -1), ("squid cake", -1), ("onion pwdr", 2)):
        assert index.find(value)[0] == want, value
    assert rm.learn(spark.createDataFrame([], "val string"), terms) == rm.Learnt() == rm.learn(spark.createDataFrame([("x",)], "val string"), [])


def test_limits_come_from_all_documents_with_sentences(spark):
    from kelpline.llm import stuffed_pages as sp

    # two thirds are wholly sentences and have few links or repeats; they count as well, and so does each single one
    row = lambda i, prose, gram: (i, "en", prose, gram, *[0.0] * (len(sp.FLOOR) - 1))
    rows = [row(i, 0.9, i / 10_000) for i in range(4000)] + [row(i, 0.4, 0.0) for i in range(4000, 6000)] + [row(9000, 0.1, 1.0)]
    limit = sp.limits_of(spark.createDataFrame(rows, sp.SCHEMA)).first()
    # 5970 of the 6000 are at most 0.3969: 2000 zeros, then 0 to 0.3969
    assert limit.max_gram == pytest.approx(1.5 * 0.3969) and limit.max_dup == sp.LEAST
    prose = "The jam is made from fruit of the old trees in our garden. Ripe plums are washed and cut in halves, with the stones put aside for a liqueur. "
    prose += "Sugar is weighed after that, and the pan stands on low heat for an hour or two. Lids have to be boiled by then, as glass cools fast on a stone floor. "
    text = prose + "Neighbours from the valley come to taste it on the first Sunday of autumn.\n" + "\n".join(f"plum jar {x}" for x in "abcdefgh")
    got = sp.measured(spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")).first()
    assert got.prose >= 0.6 and got["head"] > 0.5
    # what stands in the first characters doesn't decide the script of a text
    docs = spark.createDataFrame([(i, "en", "梅干 " * 3 + "we cook whilst the kettle sings and the bread bakes. " * 20) for i in range(60)], "doc_id long, lang string, text string")
    assert "whilst" in sp.function_words(docs)["en"]
