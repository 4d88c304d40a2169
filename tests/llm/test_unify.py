import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kelpline.llm import unify


def both(s):
    out, found = unify.unify_column(pa.array([s]))
    return out[0].as_py(), bool(found[0])


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("ｓｏｙ　ｏｉｌ", "soy oil"), ("ﾊﾟﾌﾟﾘｶ", "パプリカ"), ("ハ​゚ン", "パン"), ("crème", "crème"), ("ﬂour", "flour"), ("⼤⾖", "大豆"), ("salt mix", "salt mix"), ("sof­t", "soft"),
        ("сhісkеn", "chicken"), ("cοrn", "corn"), ("ɑpple", "apple"), ("ソルビ卜一ル", "ソルビトール"), ("力力オ", "カカオ"), ("へスチゾ", "ヘスチゾ"), ("ツバケ二乾燥", "ツバケニ乾燥"),
    ],
)
def test_folded(s, want):
    assert both(s) == (want, True)


@pytest.mark.parametrize("s", ["", "crème fraîche", "β-carotene", "αλάτι", "сахар", "уксус", "加工バター", "二度挽きクミン", "大豆、小麦", "くりペースト", "A B", "人参(一部)", "naïve 100%"])
def test_kept(s):
    assert both(s) == (s, False)


def test_null():
    out, found = unify.unify_column(pa.array([None, "ａ", None]))
    assert out.to_pylist() == [None, "a", None] and found.tolist() == [False, True, False]


@given(st.lists(st.text(max_size=12), max_size=8))
def test_batch_equals_single_and_is_stable(rows):
    rows = [r.encode("utf-8", "ignore").decode() for r in rows]
    out, _ = unify.unify_column(pa.array(rows, pa.string()))
    assert out.to_pylist() == [both(r)[0] for r in rows]
    again, found = unify.unify_column(out)
    assert again.to_pylist() == out.to_pylist() or any("̀" <= c <= "ͯ" for r in rows for c in unicodedata.normalize("NFD", r))
    del found


def test_frame_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ａ", True), (1, "ａ", True), (2, None, None)], "id int, val string, was_mixed boolean")
    got = unify.unified(df)
    assert got.columns == ["id", "val", "was_mixed"]
    assert sorted(map(str, got.collect())) == sorted(["Row(id=1, val='a', was_mixed=True)"] * 2 + ["Row(id=2, val=None, was_mixed=False)"])
    assert unify.unified(df.limit(0)).count() == 0


def test_long(spark):
    assert both("ｘ" * 300_000) == ("x" * 300_000, True)


WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)] + [chr(c) for c in range(0xFF66, 0xFFA0)] + list("abガカ")


@given(st.text(alphabet=WIDE, max_size=20))
def test_width_forms_equal_compatibility_normal_form(s):
    assert both(s)[0] == unicodedata.normalize("NFKC", s)


@given(st.text(alphabet=list("aeiouAEçñcn") + ["̀", "́", "̂", "̃", "̧"], max_size=12))
def test_single_marks_compose(s):
    if not any(a in "̧̀́̂̃" and b in "̧̀́̂̃" for a, b in zip(s, s[1:], strict=False)):
        assert both(s)[0] == unicodedata.normalize("NFC", s)


MARKED = list("aeoAñçǘậ日かハ각가") + ["̀", "́", "̂", "̃", "̈", "̧", "̣", "̱", "゙", "゚", "ᄀ", "ᅡ", "ᆨ", "ো", "ে", "া"]


@given(st.text(alphabet=MARKED, max_size=14))
def test_canonically_equal_texts_come_out_equal(s):
    want = unicodedata.normalize("NFC", s)
    assert both(s)[0] == both(unicodedata.normalize("NFD", s))[0] == both(want)[0] == want
    assert not both(want)[1]


@pytest.mark.parametrize(("s", "want"), [("\U0001d412oy", "Soy"), ("soy\u2011oil", "soy-oil"), ("ꓚ", "ꓚ"), ("caᏟao", "caCao"), ("sօy", "soy"), ("brotһ", "broth")])
def test_more_looks(s, want):
    assert both(s) == (want, s != want)
