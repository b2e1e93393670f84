"""Names, boxes and regions of one large folder or page, against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import layout, scans, spatial
from siltstone.operators.free_names import unique_names

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def plain_names(rows):
    """rows (folder, order, stem): names one after the other."""
    used, out, after = {}, {}, {}
    for f, o, s in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] or "output")):
        taken, base = used.setdefault(f, set()), s or "output"
        name, n = base, after.get((f, base), 2)  # lower numbers were taken before
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        after[f, base] = n
        out[f, o] = f"{name}.md"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_free_names(spark, seed):
    rng = random.Random(seed)
    stems = ["x", "x", "x", "x_2", "x_2_2", "x_2_3", "x_02", "x_1", "y", "", None, "output_2", "x_99999999999999999999", "a\n_3"] + [f"x_{i}" for i in range(2, 30)] + [f"x_2_2_{i}" for i in range(2, 5)]
    weights = [rng.random() ** 3 for _ in stems]
    rows = [(rng.choice(["f", "g", None]), o, rng.choices(stems, weights)[0]) for o in rng.sample(range(5000), 900)]
    got = unique_names(spark.createDataFrame(rows, "folder string, o long, stem string"), "folder", "stem", "o").collect()
    assert len(got) == len(rows) and {(r["folder"], r["o"]): r["name"] for r in got} == plain_names(rows)


def test_free_names_of_odd_tables(spark):
    empty = spark.createDataFrame([], "folder string, o long, stem string, name2 int")
    assert unique_names(empty, "folder", "stem", "o").columns == ["folder", "o", "stem", "name2", "name"]
    assert unique_names(empty, "folder", "stem", "o").count() == 0
    tied = spark.createDataFrame([("f", None, "x"), ("f", None, "x"), ("f", 1, "x_2"), ("f", 1, "x")], "folder string, o long, stem string")
    assert sorted(r["name"] for r in unique_names(tied, "folder", "stem", "o").collect()) == ["x.md", "x_2.md", "x_2_2.md", "x_3.md"]


def test_free_names_of_one_large_folder(spark):
    rows = spark.range(300_000).select(F.lit("f").alias("folder"), "id", F.when(F.col("id") % 5 > 0, "x").otherwise(F.concat(F.lit("x_"), (F.col("id") * 7919 % 200_000).cast("string"))).alias("stem"))
    got = unique_names(rows, "folder", "stem", "id").select("id", "name").toPandas()
    want = plain_names([("f", r["id"], r["stem"]) for r in rows.select("id", "stem").collect()])
    assert got["name"].nunique() == len(got) == 300_000
    assert all(want["f", i] == n for i, n in zip(got["id"].tolist(), got["name"].tolist(), strict=True))


def test_sums_before(spark):
    frame = pd.DataFrame({"k": ["a"] * 50_000 + ["b"] * 3, "o": np.random.default_rng(1).permutation(50_003)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be put into one task again
    try:
        got = scans.sums_before(spark.createDataFrame(frame), ["k"], ["o"], n=F.lit(1), s=F.col("o")).withColumn("task", F.spark_partition_id()).toPandas().sort_values(["k", "o"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = got.groupby("k")["o"]
    assert (got["n"] == groups.cumcount()).all() and (got["s"] == groups.cumsum() - got["o"]).all()
    assert got["task"].nunique() > 1 and got.groupby("task").size().max() < 40_000


def boxes(rng, n, size, side):
    at, wide = rng.uniform(0, size, (n, 2)), rng.exponential(side, (n, 2))
    return np.hstack([at, at + wide])


def frame(spark, sides, **more):
    table = pd.DataFrame(sides, columns=["x0", "y0", "x1", "y1"]).assign(id=np.arange(len(sides)), **more)
    return spark.createDataFrame(table).select("id", *more, F.struct("x0", "y0", "x1", "y1").alias("bbox"))


def shared(a, b):
    """Areas that rows of a share with rows of b."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def test_overlaps_on_a_crowded_page(spark):
    rng = np.random.default_rng(3)
    covers, texts = boxes(rng, 100_000, 20_000, 30), boxes(rng, 2_000, 20_000, 40)
    covers[:3] = [[0, 0, 9000, 9000], [5, 5, 5, 5], [-100, -100, 0.5, 12000]]
    begin = time.time()
    found = layout.uncovered(frame(spark, texts, page=1), frame(spark, covers, page=1), ["page"], "id", 0.3)
    got = {r["id"] for r in found.collect()}
    share = shared(texts, covers) / ((texts[:, 2] - texts[:, 0]) * (texts[:, 3] - texts[:, 1]))[:, None]
    assert got == set(np.flatnonzero(~(share > 0.3).any(axis=1)).tolist())
    counted = {r["id"]: r["lines"] for r in layout.lines_within(frame(spark, covers[:2000], page=1), frame(spark, texts, page=1), ["page"], "id", 0.3).collect()}
    assert [counted[i] for i in range(2000)] == (share[:, :2000] > 0.3).sum(axis=0).tolist()
    assert time.time() - begin < 120
    pairs = spatial.meeting(frame(spark, texts, page=1).withColumnRenamed("id", "t"), frame(spark, covers, page=1).withColumnRenamed("bbox", "other"), ["page"], "bbox", "other")
    assert pairs.count() == pairs.distinct().count() and "Cartesian" not in pairs._jdf.queryExecution().toString() and "_cx" in pairs._jdf.queryExecution().toString()


def test_tasks_of_meeting_boxes_grow_in_number(spark, monkeypatch):
    """Large tables are dealt into a number of tasks that Spark doesn't join again by bytes; small ones aren't."""
    rng = np.random.default_rng(2)
    a, b = boxes(rng, 4000, 3000, 20), boxes(rng, 4000, 3000, 20)
    want = int((shared(a, b) > 0).sum())

    def pairs():
        found = spatial.meeting(frame(spark, a, page=1).withColumnRenamed("id", "t"), frame(spark, b, page=1).withColumnRenamed("bbox", "other"), ["page"], "bbox", "other")
        return found, found._jdf.queryExecution().toString()

    small, plan = pairs()
    assert "REPARTITION_BY_NUM" not in plan and small.count() == want
    monkeypatch.setattr(spatial, "TASK_ROWS", 5000)
    large, plan = pairs()
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan and large.count() == want
    assert large.select(F.spark_partition_id()).distinct().count() >= 4


def test_meeting_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    a = np.round(boxes(rng, 300, 100, 1) * 4) / 4
    b = np.round(boxes(rng, 300, 100, 30) * 4) / 4
    a[:20, 2:] = a[:20, :2]  # points
    b[:20, 2] = b[:20, 0]
    b[20] = [-1e9, -1e9, 1e9, 1e9]
    want = {(i, j) for i in range(300) for j in range(300) if a[i, 0] <= b[j, 2] and b[j, 0] <= a[i, 2] and a[i, 1] <= b[j, 3] and b[j, 1] <= a[i, 3]}
    b[21] = [50, np.nan, 60, 60]
    b[22, 2] = np.inf
    want = {(i, j) for i, j in want if j not in (21, 22)}
    right = frame(spark, b, page=1).select("page", F.col("id").alias("j"), F.col("bbox").alias("other"))
    for left, turn in ((frame(spark, a, page=1), False), (frame(spark, a[:, [2, 3, 0, 1]], page=1), True)):
        got = [(r["id"], r["j"]) for r in spatial.meeting(left, right, ["page"], "bbox", "other").collect()]
        assert len(got) == len(set(got)) and set(got) == want, turn


def plain_clusters(sides, gap):
    done = {tuple(map(float, b)) for b in sides}
    while True:
        for a in done:
            near = [b for b in done if b[0] - gap <= a[2] and a[0] - gap <= b[2] and b[1] - gap <= a[3] and a[1] - gap <= b[3]]
            if len(near) > 1:
                z = list(zip(*near, strict=True))
                done = (done - set(near)) | {(min(z[0]), min(z[1]), max(z[2]), max(z[3]))}
                break
        else:
            return sorted(done)


@pytest.mark.parametrize(("gap", "step"), [(6.0, 1.0), (0.0, 1.0), (0.3, 0.1)])
def test_clusters(spark, gap, step):
    rng = np.random.default_rng(8)
    pages = {p: np.round(boxes(rng, n, size, side) / step) * step for p, n, size, side in ((1, 60, 300, 8), (2, 120, 900, 12), (None, 40, 300, 3), (4, 1, 5, 5))}
    pages[5] = np.array([[10.0 * i, 0, 10 * i + 5, 5] for i in range(40)])  # a chain, gaps of 5
    pages[6] = np.array([[0, 0, 100, 2], [0, 0, 2, 100], [50, 50, 60, 60], [300, 300, 300, 300], [300, 300, 300, 300]], dtype=float)  # an L around a box
    rows = [(p, tuple(map(float, b))) for p, bs in pages.items() for b in bs]
    got = spatial.clusters(spark.createDataFrame(rows, f"page int, bbox {BOX}"), ["page"], gap).collect()
    for p, bs in pages.items():
        assert sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in got if r["page"] == p) == plain_clusters(bs, gap), p


def test_clusters_of_odd_boxes(spark):
    nan = float("nan")
    rows = [(1, (0.0, 0.0, 1.0, 1.0)), (1, (nan, 0.0, 1.0, 1.0)), (1, (2.0, 2.0, 1.5, 1.5)), (1, (None, 0.0, 1.0, 1.0))]
    got = spatial.clusters(spark.createDataFrame(rows, f"page int, bbox {BOX}"), ["page"], 6.0).collect()
    assert sorted(str(tuple(r)) for r in got) == ["(1, 0.0, 0.0, 2.0, 2.0)", "(1, None, 0.0, 1.0, 1.0)", "(1, nan, 0.0, 1.0, 1.0)"]
    assert spatial.clusters(spark.createDataFrame([], f"page int, bbox {BOX}"), ["page"]).count() == 0


def test_clusters_of_a_crowded_page(spark):
    rng = np.random.default_rng(9)
    at = np.array([(500.0 * (i % 20), 500.0 * (i // 20)) for i in range(400)])
    spots = [np.vstack([[x, y, x, y], [x + 100, y + 100, x + 100, y + 100], [x, y, x + 100, y]] + [[x, y + s, x + 0.1, y + s + 5] for s in range(0, 100, 5)]) for x, y in at]
    inside = boxes(rng, 100_000, 99, 0.2)
    inside = np.minimum(inside, 100) + np.tile(np.repeat(at, 250, axis=0), 2)
    begin = time.time()
    got = spatial.clusters(frame(spark, np.vstack([*spots, inside]), page=1), ["page"], 6.0).collect()
    assert sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in got) == sorted((x, y, x + 100, y + 100) for x, y in at)
    assert time.time() - begin < 180


def plain_table(cells, max_rows, max_cols):
    full = {}
    for r, c, v, kind in sorted(cells, key=lambda x: (x[0], x[1], x[2] or "", x[3] == "number")):
        if (v or "").strip(" "):
            full[r, c] = (v, kind)
    if not full:
        return None
    r0, c0 = min(r for r, _ in full), min(c for _, c in full)
    full = {(r, c): x for (r, c), x in full.items() if (not max_rows or r < r0 + max_rows) and (not max_cols or c < c0 + max_cols)}
    if not full:
        return None
    rows, cols = range(r0, max(r for r, _ in full) + 1), range(c0, max(c for _, c in full) + 1)
    lines = ["| " + " | ".join(full.get((r, c), ("",))[0] for c in cols) + " |" for r in rows]
    below = {c: [k for (r, d), (_, k) in full.items() if d == c and r > r0] for c in cols}
    lines.insert(1, "| " + " | ".join("---:" if below[c] and set(below[c]) == {"number"} else "---" for c in cols) + " |")
    return "\n".join(lines)


@pytest.mark.parametrize(("max_rows", "max_cols"), [(0, 0), (3, 0), (0, 2), (4, 3)])
def test_pipe_tables(spark, max_rows, max_cols):
    rng = random.Random(7)
    rows = [(s, r, c, rng.choice([None, "", " ", "a", "b c", "7", "\t"]), rng.choice(["number", "number", "text", None])) for s in range(60) for r, c in rng.sample([(r, c) for r in range(2, 9) for c in range(1, 7)], rng.randrange(1, 14))]
    rows += [(s, r, c, "other", "text") for s, r, c, *_ in rows[::9]] + [(99, 5, 5, " ", "text"), (None, 1, 400, "wide", "number"), (None, 500, 1, "tall", "number")]
    got = layout.pipe_table(spark.createDataFrame(rows, "sheet int, row int, col int, value string, kind string"), ["sheet"], max_rows, max_cols).collect()
    want = {s: t for s in {r[0] for r in rows} if (t := plain_table([r[1:] for r in rows if r[0] == s], max_rows, max_cols))}
    assert {r["sheet"]: r["markdown"] for r in got} == want


def test_pipe_table_of_a_large_sheet(spark):
    cells = spark.range(60_000).select(F.lit(1).alias("sheet"), F.floor(F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.col("id").cast("string").alias("value"), F.lit("number").alias("kind"))
    begin = time.time()
    lines = layout.pipe_table(cells, ["sheet"]).first()["markdown"].split("\n")
    assert len(lines) == 2001 and lines[1] == "|" + " ---: |" * 30 and lines[-1].endswith(" 59999 |") and lines[2].startswith("| 30 | 31 |")
    assert time.time() - begin < 30
