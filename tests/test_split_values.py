import csv
import random

import pyarrow as pa
import pytest

from kelpline.operators.split_values import split_block, split_values


def values(s):
    return split_block(pa.array([s]))[2].to_pylist()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("a", ["a"]),
        (" ,, a ,,b / ", ["a", "b"]),
        ("a、b，c､d；e|f／g・h\ti", list("abcdefghi")),
        ('"pumpkin oil 2%, ""light"" grade"; x', ['pumpkin oil 2%, "light" grade', "x"]),
        ("「扁豆薄片／上」;\"檸檬調味料 35%\";大豆（大豆、小麦を含む）。", ["扁豆薄片／上", "檸檬調味料 35%", "大豆（大豆、小麦を含む）"]),
        ("1. carrot paste 2. zed 4,874mg 3. sweet 59%", ["carrot paste", "zed 4,874mg", "sweet 59%"]),
        ("1) a 2) b", ["a", "b"]),
        ("1) a (soy, wheat) 2) b [x; y] 3) c", ["a (soy, wheat)", "b [x; y]", "c"]),
        ("1) a (type 2) 2) b", ["a (type 2)", "b"]),
        ("1. a 3. b, c", ["a 3. b", "c"]),
        ("①栗②芥子③x。", ["栗", "芥子", "x"]),
        ("a [batch A; batch B], b", ["a [batch A; batch B]", "b"]),
        ("squid oil 8,345mg", ["squid oil 8,345mg"]),
        ('"x', ['"x']),
        ("a (b, c", ["a (b", "c"]),
        ("「a」「b」,c", ["「a」「b」", "c"]),
        ("type 2. x, y", ["type 2. x", "y"]),
        ("β-carotene, x", ["β-carotene", "x"]),
        ("。", []),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_positions_follow_rows():
    parent, pos, val = split_block(pa.array([None, "a,b", "", "c", "d,e,f"]))
    assert list(zip(parent.tolist(), pos.tolist(), val.to_pylist(), strict=True)) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c"), (4, 1, "d"), (4, 2, "e"), (4, 3, "f")]


def test_quoting_against_csv_module():
    rng = random.Random(3)
    for _ in range(300):
        cells = ["".join(rng.choice('ab,;"') for _ in range(rng.randint(1, 6))).strip() or "a" for _ in range(rng.randint(2, 5))]
        cells = [c if c.strip('",; ') else "z" for c in cells]
        line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
        assert values(line) == [c.strip() for c in next(csv.reader([line]))]


def test_batch_equals_single_rows():
    rng = random.Random(4)
    rows = ["".join(rng.choice("ab,、\"「」()12. ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    parent, _, val = split_block(pa.array(rows))
    got = [[] for _ in rows]
    for p, v in zip(parent.tolist(), val.to_pylist(), strict=True):
        got[p].append(v)
    assert got == [values(r) for r in rows]


def test_frame(spark):
    df = spark.createDataFrame([("f", 1, 0, "a,b", 9), ("f", 1, 0, "a,b", 9), ("f", 2, 1, None, 9), ("f", 3, 0, "single", 9)], "field string, row_id long, elem int, text string, val int")
    rows = sorted(map(tuple, split_values(df, 2).collect()))
    assert rows == [("f", 1, 0, 1, "a"), ("f", 1, 0, 1, "a"), ("f", 1, 0, 2, "b"), ("f", 1, 0, 2, "b")]
    assert split_values(df.limit(0)).count() == 0


def test_very_long(spark):
    n = 200_000
    assert len(values(",".join(["ab"] * n))) == n
