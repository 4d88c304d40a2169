import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import page_lines as pl
from kelpline.llm import scan_repair as sr


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    docs, scans, last = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "scan_log", "last_scans"))
    words, trigrams = sr.known_text(docs)
    return sr.fit(sr.clean_sample(docs), words=words, trigrams=trigrams, furniture=pl.furniture_words(sr.page_texts(scans, last)))


def test_kinds_of_lines(model):
    text = "Sogiriro soup cup\nZutomi Foods Quality manual Rev. 4\nKeep the pack dry - do not\nfreeze it aftcr opening. The auditor vis=\nited the plant.\n- 12 -\n"
    (r,) = sr.repair([text], model)
    assert r.kinds == [set(), {"header"}, set(), {"glyph", "hyphen"}, set(), {"pageno"}, set()]
    assert r.text == "Sogiriro soup cup Keep the pack dry - do not freeze it after opening. The auditor visited the plant."


def test_clean_text_stays(model):
    text = "Keep the pack dry - do not freeze it after opening.\n\nThe list is short: nothing but water and salt."
    (r,) = sr.repair([text], model)
    assert not any(r.kinds) and r.text == text


@pytest.mark.parametrize("text", ["", "\n", "\r\n\r\n", "x", "12", "-", "a-\nb", "1\n2\n3", "-\n-\n"])
def test_odd_texts(model, text):
    (r,) = sr.repair([text], model)
    assert len(r.kinds) == text.count("\n") + 1


def test_batch_equals_single(model, spark, data):
    rows = spark.read.parquet(f"{data}/last_scans.parquet").filter("raw_text is not null").select("raw_text").collect()
    texts = [r.raw_text for r in rows]
    one = [sr.repair([t], model)[0] for t in texts]
    assert sr.repair(texts, model) == one


def test_held_out_misreadings(model, spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en' and source = 'maker_site' and text is not null").orderBy("doc_id").select("text").limit(300).collect()
    sentences = [s for r in rows for s in r.text.split("\n") if len(s) > 60 and "http" not in s][:400]
    rng = random.Random(9)
    by_char = {}
    for t, r in sr.MISREAD:
        by_char.setdefault(t, []).append(r)
    _, label = sr.labels()
    spoiled = [sr._spoil(s, rng, by_char, label, 0.01)[0] for s in sentences]
    done = sr.repair(spoiled, model)
    mended = sum(d.text == s.strip() for d, s in zip(done, sentences, strict=True))
    hurt = sum(any(d.kinds) for d, s, x in zip(done, sentences, spoiled, strict=True) if x == s)
    assert mended >= 0.92 * len(sentences) and hurt == 0


def test_long_text_and_frames(model, spark):
    long = "The list is short: nothing but water and salt.\n" * 20_000
    df = spark.createDataFrame([("f", 1, 0, long), ("f", 1, 0, None), ("f", 2, 0, ""), ("f", 2, 0, "")], "field string, row_id long, pass_no int, text string").selectExpr("1 as kind", "*", "2 as line_no")
    assert sr.noisy_lines(df, model).count() == 0
    assert sr.repaired_texts(df, model).count() == 3
    assert sr.noisy_lines(df.limit(0), model).count() == 0


def test_nothing_to_learn_from():
    m = sr.fit([])
    assert sr.repair(["a\nb"], m)[0].text == "a b"


ENGLISH = ["The supplier changed the drying step in spring and", "now keeps the leaves in the dark for two weeks before", "they are milled. Nobody at the counter could say when", "the next delivery will arrive.", "Most readers asked for a shorter list on the lid and", "for larger letters on the back of the pack, which the", "printer said would cost a little more. The committee", "will meet again after the harvest and decide then.", "A second drawing hangs beside the door of the mill and", "shows how the old wheel was turned by the stream."]
JAPANESE = ["乾燥の工程は春に変わり、今は葉を暗いところに二週間", "置いてから挽いています。次の入荷がいつになるかは店", "の人にも分かりませんでした。", "読者の多くは表の字を大きくし、一覧を短くしてほしい", "と書いていました。印刷所はその分だけ費用がかかると", "答えました。収穫のあとでもう一度話し合います。", "古い水車の絵が戸口の横に掛かっていて、川の水でどう", "回したかを示しています。"]
# held out: none of these titles and forms is in what the model is trained on
TITLES = ["Annual Safety Handbook", "Chapter 3: Raw Materials", "Kestrel Laboratories - Volume 2", "Zutomi Cannery Yearbook", "THE WEEKLY GROCER", "Minutes of the tasting panel", "Section IV | Storage", "Regional Harvest Survey 2014", "Appendix B", "年次報告書", "第三章 貯蔵", "安全衛生の手引き 改訂二号"]
NUMBERS = [["iii", "iv", "v"], ["- iii -", "- iv -", "- v -"], ["4", "5", "6"], ["- 4 -", "- 5 -", "- 6 -"], ["Page 4 of 9", "Page 5 of 9", "Page 6 of 9"], ["4/8", "5/8", "6/8"], ["三", "四", "五"], ["", "", ""]]


def test_held_out_furniture(spark):
    """Learnt from one language's clean text alone, without scans."""
    m = sr.fit(sr.clean_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    seen = {"header": [0, 0], "pageno": [0, 0], None: [0, 0]}
    for title in TITLES:
        body = ENGLISH if title[0].isascii() else JAPANESE
        for numbers in NUMBERS:
            for pages in (2, 3):
                lines = [x for p in range(pages) for x in ((title, "header"), *((s, None) for s in body[p * len(body) // pages : (p + 1) * len(body) // pages]), (numbers[p], "pageno")) if x[0]]
                (r,) = sr.repair(["\n".join(x for x, _ in lines)], m)
                for (_, want), kinds in zip(lines, r.kinds, strict=True):
                    seen[want][0] += (want in kinds) if want else bool(kinds & {"header", "pageno"})
                    seen[want][1] += 1
    assert seen["header"][0] >= 0.9 * seen["header"][1] and seen["pageno"][0] >= 0.9 * seen["pageno"][1] and seen[None][0] <= 0.02 * seen[None][1], seen


def test_misreadings_of_one_look():
    words = {"modern": 5, "clear": 4, "kitchen": 3, "summer": 2, "recommended": 1}
    m = sr.Model(np.zeros((1 << pl.BITS, 3), np.float32), np.zeros((1 << 17, len(sr.labels()[0])), np.float16), words, looks={sr.look(w): (w,) for w in words})
    for read, want in (("rnodcrri", "modern"), ("dcar", "clear"), ("kitclien", "kitchen"), ("5ummer", "summer"), ("recorrirricrictcd", None), ("rec0mmcnded", "recommended"), ("m0dcrn", "modern")):
        e = sr._same_look(read, m)
        assert ("".join(e.get(i, c) for i, c in enumerate(read)) if e else None) == want


def test_text_of_all_documents_counts(spark):
    docs = spark.createDataFrame([("salt and water",), ("salt, 塩と水",), ("塩と水",), (None,), ("",)], "text string")
    words, grams = sr.known_text(docs)
    assert words == {"salt": 2} and grams == {sr._packed("塩と水")}
    assert sr.known_text(docs.limit(0)) == ({}, frozenset())
    assert len(pl.furniture_words(docs)) == 0 and len(pl.furniture_words(docs.limit(0))) == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="İıivx 12-\n\r第頁一十rn0塩ァ", max_size=30)), min_size=1, max_size=4))
def test_any_text(model, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    done = sr.repair(texts, model)
    assert [len(r.kinds) for r in done] == [t.count("\n") + 1 for t in texts]
    assert done == [sr.repair([t], model)[0] for t in texts]


@pytest.mark.parametrize(("line", "want"), [("iv", (2, 4)), ("XIX", (2, 19)), ("第十二頁", (3, 12)), ("- 7 -", (1, 7)), ("Page 3 of 9", (1, 3)), ("İ", (0, 0)), ("mix", (0, 0)), ("", (0, 0)), ("二百三十", (3, 230))])
def test_page_numbers(line, want):
    assert pl._number(line) == want
