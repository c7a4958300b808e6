from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import layout
from quire.operators.ordered import Ordered, with_global_index, with_group_index

SCHEMA = "page_id int, ordinal int, text string, x double, y double, w double, h double"


def page(spark, *blocks, page_id=1):
    rows = [(page_id, i, text, x, y, w, 0.05) for i, (text, x, y, w) in enumerate(blocks)]
    return spark.createDataFrame(rows, SCHEMA)


def ordered_texts(df):
    rows = layout.reading_order(df, ["page_id"], ["ordinal"]).orderBy("reading_order").collect()
    assert [r.reading_order for r in rows] == list(range(len(rows)))
    return [r.text for r in rows]


TWO_COLUMNS = [("L1", 0.05, 0.8, 0.35), ("R1", 0.55, 0.8, 0.35), ("L2", 0.05, 0.6, 0.35), ("R2", 0.55, 0.6, 0.35)]


@pytest.mark.parametrize(
    ("blocks", "expected"),
    [
        ([("bottom", 0.1, 0.1, 0.3), ("top", 0.1, 0.8, 0.3), ("middle", 0.1, 0.45, 0.3)], ["top", "middle", "bottom"]),
        ([("right", 0.6, 0.8, 0.2), ("left", 0.1, 0.802, 0.2), ("middle", 0.35, 0.799, 0.2)], ["left", "middle", "right"]),
        (TWO_COLUMNS, ["L1", "L2", "R1", "R2"]),
        (
            [("Heading", 0.05, 0.9, 0.9)] + [(t, x, y - 0.1, w) for t, x, y, w in TWO_COLUMNS],
            ["Heading", "L1", "R1", "L2", "R2"],
        ),
        ([("only", 0.1, 0.1, 0.3)], ["only"]),
        ([], []),
    ],
)
def test_reading_order(spark, blocks, expected):
    assert ordered_texts(page(spark, *blocks)) == expected


@pytest.mark.parametrize(
    ("blocks", "expected"),
    [
        ([("second line", 0.1, 0.6, 0.3), ("first", 0.1, 0.8, 0.2), ("line", 0.32, 0.8, 0.2)], "first line\nsecond line"),
        (TWO_COLUMNS, "L1\nL2\nR1\nR2"),
        ([("  ", 0.1, 0.8, 0.2), (" a ", 0.32, 0.8, 0.1), ("", 0.1, 0.6, 0.2), ("b", 0.1, 0.4, 0.2)], "a\nb"),
        ([(" ", 0.1, 0.8, 0.2)], ""),
    ],
)
def test_page_text(spark, blocks, expected):
    rows = layout.order_and_compose(page(spark, *blocks), ["page_id"], ["ordinal"]).collect()
    assert [(r.part, r.page_text) for r in rows] == [(0, expected)]


def random_blocks(spark, pages=6, seed=3):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for i in range(40 if p == 0 else rng.randint(1, 7)):
            x = rng.choice([0.02, 0.1, 0.3, 0.5, 0.55, 0.7])
            w = rng.choice([0.1, 0.2, 0.3]) if p % 2 else 0.15
            text = rng.choice(["a", "bb", " ", "ccc"])
            rows.append((p, i, text, x, rng.randint(0, 12) / 14, w, rng.choice([0.02, 0.05, 0.09])))
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(blocks):
    """Reading order and text of one page, stated over plain lists."""

    def shares(a, b):
        overlap = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
        return overlap > 0 and min(a.h, b.h) > 0 and overlap / min(a.h, b.h) >= 0.35

    left = [b for b in blocks if b.x + b.w <= 0.52]
    right = [b for b in blocks if b.x + b.w > 0.52 and b.x >= 0.48]
    split = len(left) + len(right) == len(blocks) and len(left) > 1 and len(right) > 1
    order = []
    for column in [left, right] if split else [blocks]:
        lines = []
        for block in sorted(column, key=lambda b: (-(b.y + b.h / 2), b.ordinal)):
            if lines and shares(block, lines[-1][-1]):
                lines[-1].append(block)
            else:
                lines.append([block])
        for line in lines:
            order += sorted(line, key=lambda b: (b.x, -(b.y + b.h / 2), b.ordinal))
    texts, before = [], None
    for block in order:
        if before is not None and shares(block, before) and block.x >= before.x:
            texts[-1].append(block.text.strip())
        else:
            texts.append([block.text.strip()])
        before = block
    joined = [" ".join(w for w in words if w) for words in texts]
    return [b.ordinal for b in order], "\n".join(line for line in joined if line)


def check_against_brute_force(spark, part_blocks):
    blocks = random_blocks(spark)
    by_page = {}
    for row in blocks.orderBy("page_id", "ordinal").collect():
        by_page.setdefault(row.page_id, []).append(row)
    want = {key: brute_force(rows) for key, rows in by_page.items()}
    got = {}
    for row in layout.reading_order(blocks, ["page_id"], ["ordinal"]).orderBy("reading_order").collect():
        got.setdefault(row.page_id, []).append(row.ordinal)
    assert got == {key: order for key, (order, _) in want.items()}
    texts = {}
    composed = layout.order_and_compose(blocks, ["page_id"], ["ordinal"], part_blocks)
    for row in composed.orderBy("page_id", "part").collect():
        texts[row.page_id] = texts.get(row.page_id, "") + row.page_text
    assert texts == {key: text for key, (_, text) in want.items()}


def test_layout_against_brute_force(spark):
    check_against_brute_force(spark, 100_000)


def test_sorter_options(spark):
    """Two columns of two lines; the lines of the right one lie a little lower."""
    rows = [(0, 0, "a", 0.1, 0.80, 0.3, 0.1), (0, 1, "b", 0.6, 0.76, 0.3, 0.1), (0, 2, "c", 0.1, 0.50, 0.3, 0.1), (0, 3, "d", 0.6, 0.46, 0.3, 0.1)]
    blocks = spark.createDataFrame(rows, SCHEMA)

    def order(**options):
        found = layout.reading_order(blocks, ["page_id"], ["ordinal"], **options).orderBy("reading_order").collect()
        return [r.ordinal for r in found], len({(r.column_id, r.line_id) for r in found})

    assert order() == ([0, 2, 1, 3], 4)
    assert order(detect_columns=False) == ([0, 1, 2, 3], 2)
    assert order(detect_columns=False, same_line_ratio=0.9) == ([0, 1, 2, 3], 4)
    assert {r.column_id for r in layout.group_lines(blocks, ["page_id"], ["ordinal"], detect_columns=False).collect()} == {0}
    text = layout.order_and_compose(blocks, ["page_id"], ["ordinal"], detect_columns=False).first().page_text
    assert text == "a b\nc d"


def test_layout_with_hot_pages(spark, hot_limits):
    check_against_brute_force(spark, 7)


def test_column_statistics(spark):
    row = layout.column_statistics(page(spark, *TWO_COLUMNS), ["page_id"]).first()
    assert (row.left_count, row.right_count, row.spanning_count, row.two_columns) == (2, 2, 0, True)


def sequence_rows(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 9), i, rng.randint(0, 5)) for i in range(200)]
    return rows, spark.createDataFrame(rows, "k int, i int, v int").repartition(4)


@pytest.mark.parametrize("slices", [0, 60])
def test_ordered_scans(spark, hot_limits, slices):
    rows, df = sequence_rows(spark)
    scan = Ordered(df, ["k"], [F.col("v"), F.col("i")], slices)
    scan.lag({"prev": "i"}, first="start").running_sum(F.col("v"), "total").max_before(F.col("i"), "top").index("n")
    got = {(r.k, r.i): (r.prev, r.start, r.total, r.top, r.n) for r in scan.done().collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        prev, total, top = None, 0, None
        for n, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))):
            total += v
            want[key, i] = (prev, prev is None, total, top, n)
            prev, top = i, i if top is None else max(top, i)
    assert got == want


def test_group_and_global_index(spark, hot_limits):
    rows, df = sequence_rows(spark)
    placed = with_global_index(df, [F.col("v").desc(), F.col("i")], "n").collect()
    assert [r.i for r in sorted(placed, key=lambda r: r.n)] == [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))]
    assert sorted(r.n for r in placed) == list(range(200))
    grouped = with_group_index(df, ["k"], [F.col("i")], "n").collect()
    want = {i: sum(1 for r in rows if r[0] == k and r[1] < i) for k, i, _ in rows}
    assert {r.i: r.n for r in grouped} == want


RECTS = [(0.25, 0.6, 0.5, 0.2, 200.0, 100.0), (0.0, 0.9, 1.0, 0.1, 200.0, 100.0), (0.1, 0.15, 0.3, 0.25, 640.0, 480.0)]


def test_rectangles(spark):
    df = spark.createDataFrame([*RECTS, (0.1, 0.1, 0.1, 0.1, 0.0, 0.0)], "x double, y double, w double, h double, iw double, ih double")
    c = [F.col(n) for n in ("x", "y", "w", "h", "iw", "ih")]
    rows = df.withColumn("r", g.to_image_rect(*c)).withColumn(
        "b", g.to_normalized_rect(F.col("r.x"), F.col("r.y"), F.col("r.w"), F.col("r.h"), c[4], c[5])
    ).collect()
    assert tuple(rows[0].r) == pytest.approx((50, 20, 100, 20), abs=1e-4)
    assert rows[1].r.y == pytest.approx(0, abs=1e-4)
    for row, rect in zip(rows, RECTS):
        assert tuple(row.b) == pytest.approx(rect[:4], abs=1e-4)
    assert tuple(rows[3].r) == (0, 0, 0, 0) and tuple(rows[3].b) == (0, 0, 0, 0)


def test_crop_plan(spark):
    sizes = spark.createDataFrame([(1, 1600, 2200), (2, 600, 2400), (3, 0, 10)], "id int, width int, height int")
    rows = g.plan_crops(sizes).orderBy("id", "crop_index").collect()
    first = [r for r in rows if r.id == 1]
    assert len(first) == 3 and first[0].crop_y == 0
    assert first[-1].crop_y + first[-1].crop_h == pytest.approx(1)
    overlap = first[0].crop_y + first[0].crop_h - first[1].crop_y
    assert overlap / first[0].crop_h == pytest.approx(0.20)
    assert len([r for r in rows if r.id == 2]) == 6 and len([r for r in rows if r.id == 3]) == 3


@pytest.mark.parametrize("hot", [False, True])
def test_reindex_and_line_flags(spark, request, hot):
    if hot:
        request.getfixturevalue("hot_limits")
    blocks = random_blocks(spark).withColumn("reading_order", F.col("ordinal") * 10)
    rows = layout.line_flags(layout.reindex(blocks, ["page_id"], ["ordinal"]), ["page_id"]).collect()
    assert all(r.reading_order == r.ordinal for r in rows)
    for p in {r.page_id for r in rows}:
        lines = [r.text_line for r in sorted((r for r in rows if r.page_id == p), key=lambda r: r.ordinal)]
        flags = [r.continues_line for r in sorted((r for r in rows if r.page_id == p), key=lambda r: r.ordinal)]
        assert lines[0] == 1 and all(b - a == (0 if f else 1) for a, b, f in zip(lines, lines[1:], flags[1:]))
