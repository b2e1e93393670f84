"""Pixels of vector shapes against a test of every pixel by itself."""

from __future__ import annotations

import random

from siltstone.operators import raster

SHAPES = "page int, id int, ring array<struct<x:double,y:double>>, region struct<x0:double,y0:double,x1:double,y1:double>"
REGION = (10.0, 20.0, 90.0, 75.5)


def plain(rings, region, dpi):
    """Pixels whose centre an odd number of sides of the rings leave on their left."""
    k = dpi / 72
    out = set()
    for row in range(200):
        for x in range(200):
            if x >= (region[2] - region[0]) * k or row >= (region[3] - region[1]) * k:
                continue
            n = 0
            for ring in rings:
                p = [((a - region[0]) * k, (b - region[1]) * k) for a, b in ring if a is not None and b is not None]
                for (a, b), (u, v) in zip(p, p[1:] + p[:1], strict=True):
                    if (b <= row + 0.5) != (v <= row + 0.5) and a + (row + 0.5 - b) * (u - a) / (v - b) <= x + 0.5:
                        n += 1
            if n % 2:
                out.add((row, x))
    return out


def pixels(runs):
    out = {}
    for r in runs.collect():
        run = {(r["row"], x) for x in range(r["x0"], r["x1"])}
        assert not run & out.setdefault(r["id"], set())
        out[r["id"]] |= run
    return out


def test_runs_are_the_pixels_inside(spark):
    rng = random.Random(4)
    rings = {i: [[(rng.choice((rng.uniform(0, 110), rng.randint(0, 110))), float(rng.randint(0, 200)) / 2) for _ in range(rng.randint(3, 9))]] for i in range(25)}
    rings = {i: [[(float(a), b) for a, b in r] for r in v] for i, v in rings.items()}
    rings[30] = [[(12.0, 22.0), (60.0, 22.0), (60.0, 70.0), (12.0, 70.0)], [(20.0, 30.0), (40.0, 30.0), (40.0, 50.0), (20.0, 50.0)]]  # a hole
    rings[31] = [[(15.0, 30.0), (None, 3.0), (55.0, 30.0), (55.0, 66.0)]]
    rings[32] = [[(15.0, 30.0), (55.0, 30.0)]]
    rings[33] = rings[30][:1] * 2  # a repeated row cancels
    rows = [(1, i, r, REGION) for i, v in rings.items() for r in v] + [(1, 40, None, REGION), (1, 41, [], REGION), (1, 42, rings[30][0], (5.0, 5.0, 5.0, 9.0)), (1, 43, rings[30][0], None)]
    shapes = spark.createDataFrame(rows, SHAPES).selectExpr("*", "'clash' AS row", "'clash' AS x", "'clash' AS _at")
    for dpi in (72, 50):
        got = pixels(raster.filled_runs(shapes, ["page", "id"], dpi))
        want = {i: p for i, v in rings.items() if (p := plain(v, REGION, dpi))}
        assert got == want and {32, 33, 40, 41, 42, 43}.isdisjoint(got) and len(want) > 20
    assert raster.filled_runs(shapes.limit(0), ["page", "id"], 72).count() == 0


def test_later_shapes_cover_earlier_ones(spark):
    boxes = {1: (10.0, 20.0, 30.0, 40.0), 2: (20.0, 30.0, 50.0, 50.0), 3: (25.0, 20.0, 28.0, 75.0)}
    rows = [(1, i, [(a, b), (c, b), (c, d), (a, d)], REGION) for i, (a, b, c, d) in boxes.items()]
    runs = raster.filled_runs(spark.createDataFrame(rows, SHAPES), ["page", "id"], 72)
    want = {}
    for i, (a, b, c, d) in boxes.items():
        want |= {(y, x): i for y in range(int(b) - 20, int(d) - 20) for x in range(int(a) - 10, int(c) - 10)}
    assert {(r["row"], r["x"]): r["id"] for r in raster.painted(runs, ["page"], "id").collect()} == want


def test_a_shape_of_very_many_sides(spark):
    """A comb of 100,000 teeth, of which every 125th has its tip on a pixel's centre: its rows are in many groups."""
    teeth = 100_000
    ring = f"transform(sequence(0, {2 * teeth - 1}), i -> struct(CAST(i AS DOUBLE) / {teeth} * 400 AS x, CAST(i % 2 * 500 AS DOUBLE) AS y))"
    shapes = spark.range(1).selectExpr("1 AS page", "1 AS id", f"concat({ring}, array(struct(800D AS x, 600D AS y), struct(0D AS x, 600D AS y))) AS ring", "struct(0.5D AS x0, 0D AS y0, 800.5D AS x1, 20D AS y1) AS region")
    got = raster.filled_runs(shapes, ["page", "id"], 72).groupBy("row").count().collect()
    assert sorted(tuple(r) for r in got) == [(i, 799) for i in range(20)]
