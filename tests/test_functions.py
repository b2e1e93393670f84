"""Column functions against values known or computed otherwise."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions import geo, markdown, names, rounding, shapes, windpower
from siltstone.operators import text_units
from siltstone.sources import geofiles


def one(spark: SparkSession, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_round_trip_of_coordinates(spark):
    grid = spark.range(0, 2000).select((73.7 + F.col("id") % 61).alias("lon"), (3.9 + F.floor(F.col("id") / 61) * 1.5).alias("lat"))
    lon, lat = geo.wgs84_to_gcj02(F.col("lon"), F.col("lat"))
    back = geo.gcj02_to_wgs84(lon, lat)
    worst = grid.where(geo.in_box(lon, lat)).select(F.greatest(F.abs(back[0] - F.col("lon")), F.abs(back[1] - F.col("lat"))).alias("e")).agg(F.max("e")).first()[0]
    assert worst < 1e-4


def test_outside_the_box_nothing_moves(spark):
    p = geo.wgs84_to_gcj02(F.lit(2.35), F.lit(48.85))
    assert one(spark, *p) == (2.35, 48.85)


@pytest.mark.parametrize("pair", sorted(geo.CONVERSIONS))
def test_columns_agree_with_plain_python(spark, pair):
    f = geofiles.transform(*pair, digits=12)
    got = one(spark, *geo.convert(F.lit(116.397), F.lit(39.909), *pair))
    assert got == pytest.approx(f(116.397, 39.909), abs=1e-9)


def test_system_names(spark):
    assert [geo.system_key(x) for x in ("高德", " GPS ", "09")] == ["gcj02", "wgs84", "bd09"]
    with pytest.raises(ValueError):
        geo.system_key("mars")
    assert one(spark, geo.system_key_column(F.lit("mars"))) is None


def test_point_tokens(spark):
    assert one(spark, *geo.parse_point(F.lit("1，2"))) == (1.0, 2.0)
    assert one(spark, *geo.parse_point(F.lit(" 1  2 "), lat_first=True)) == (2.0, 1.0)
    assert one(spark, *geo.parse_point(F.lit("1,2,3"))) == (None, None)


def test_power_coefficient_of_the_worked_example(spark):
    assert one(spark, windpower.theoretical_kw(F.lit(3.0), 1.02, 220.0)) == pytest.approx(523.44, abs=0.01)
    assert one(spark, windpower.cp(F.lit(3.0), F.lit(186.4), 1.02, 220.0)) == pytest.approx(0.3561, abs=1e-4)
    assert one(spark, windpower.cp(F.lit(0.0), F.lit(1.0), 1.02, 220.0)) is None


@pytest.mark.parametrize(
    ("line", "want"),
    [("3 186.4 0.8", (3.0, 186.4, 0.8)), ("3,186.4,0.8", (3.0, 186.4, 0.8)), ("10  1,234.5", (10.0, 1234.5, None)), (".5 1e3", (0.5, 1000.0, None)), ("V P", None), ("7", None), ("", None)],
)
def test_curve_lines(spark, line, want):
    got = one(spark, windpower.curve_line(F.lit(line)))
    assert (tuple(got) if got else None) == want


def test_parameters(spark):
    assert one(spark, windpower.model_diameter(F.lit("x\n机型 G5000-200\n"))) == 200.0
    code = lambda r, d, h: one(spark, windpower.parameter_error(F.lit(r), F.lit(d), F.lit(h).cast("double")))
    assert (code(1.2, 220.0, 200.0), code(0.1, 220.0, None), code(1.2, 10.0, None), code(1.2, 230.0, 200.0)) == (None, "density", "diameter", "model")


def test_markdown_statistics(spark):
    text = "# A\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![i](x.png) [l](u) [m](v)\n| c |\n"
    assert tuple(one(spark, markdown.statistics(F.lit(text)))) == (8, len(text), 1, 2, 1, 2)
    assert tuple(one(spark, markdown.statistics(F.lit(None).cast("string")))) == (0, 0, 0, 0, 0, 0)


def test_blank_lines_and_images(spark):
    assert one(spark, markdown.collapse_blank(F.lit("a  \n\n \n\nb"))) == "a\n\nb"
    assert one(spark, markdown.strip_images(F.lit("a\n![x](y)\nb ![z](w)c"))) == "a\nb c"
    assert one(spark, markdown.html_images(F.lit('<img src="p.png" alt="P"> <IMG alt="Q" src="q.png"/>'))) == "![P](p.png) ![Q](q.png)"


@pytest.mark.parametrize(
    ("text", "want"),
    [("• x", (True, "ul", "- x")), ("– x", (True, "ul", "- x")), ("3、x", (True, "ol", "3. x")), ("x", (False, None, "x")), ("", (False, None, ""))],
)
def test_list_items(spark, text, want):
    assert tuple(one(spark, markdown.list_item(F.lit(text)))) == want


def test_heading_levels(spark):
    level = lambda size, text, flags: one(spark, markdown.heading_level(F.lit(size), F.lit(10.0), F.lit(20.0), F.lit(11.5), F.lit(None).cast("double"), F.lit(text), F.lit(flags)))
    assert [level(20.0, "Title", 0), level(11.5, "Sub", 0), level(11.5, "Sub", 16), level(20.0, "It ends.", 16), level(20.0, "1. Ends.", 16), level(10.0, "x", 16), level(20.0, "x" * 81, 16)] == [1, 0, 2, 0, 1, 0, 0]


def test_placeholders_and_translatable(spark):
    err = lambda t, n: one(spark, markdown.placeholder_error(F.lit(t), F.lit(n)))
    assert (err("[t:0] a [t:1]", 2), err("[t:1][t:0]", 2), err("a", 0), err("[t:0]", 0)) == (None, "placeholders", None, "placeholders")
    ok = lambda t: one(spark, markdown.is_translatable(F.lit(t)))
    assert [ok(x) for x in ("word", " 12-3 ", "https://a.b/c", "a@b.c", "", "é!")] == [True, False, False, False, False, True]


def test_names(spark):
    assert one(spark, names.safe_name(F.lit(" a  b/标题!__c"))) == "_a_b标题_c"
    assert one(spark, F.array_join(names.natural_key(F.lit("Ch10a")), "|")) == "ch|" + "10".zfill(20) + "|a"
    assert one(spark, names.source_type(F.lit("a/b.PDF"))) == "pdf"
    assert one(spark, names.suffix(F.lit("a/.hidden"))) == ""
    assert one(spark, names.image_name(F.lit("https://x.y/"), F.lit(3), F.lit("image/png"))) == "image_3.png"


def test_shapes(spark):
    a, b = shapes.rect(*[F.lit(x) for x in (0, 0, 10, 10)]), shapes.rect(*[F.lit(x) for x in (5, 5, 20, 20)])
    assert one(spark, shapes.overlap(a, b)) == 0.25
    assert one(spark, shapes.overlap(shapes.rect(*[F.lit(0)] * 4), b)) == 0.0
    assert one(spark, shapes.is_red(F.lit(200), F.lit(50), F.lit(50)), shapes.is_red(F.lit(200), F.lit(170), F.lit(50))) == (True, False)
    assert one(spark, shapes.length_emu(F.lit("1.5in")), shapes.length_emu(F.lit("2em"))) == (1371600, None)
    keep = shapes.early_image_checks(F.lit(99), F.lit(500), F.lit(9999))
    assert one(spark, keep) is False


@pytest.mark.parametrize("x", [0.0, 186.4, 1234567.0, 0.0001, 1e-5, -2.5, 100000.0, 999999.5, 3.0, 1 / 3])
def test_general_numbers(spark, x):
    assert one(spark, rounding.general(F.lit(x))) == f"{x:g}"


def test_general_formats_a_number_at_most_twice(spark):
    """Formatting is most of what a report costs; the expression names each format once."""
    values = [None, float("inf"), float("-inf"), float("nan"), 12.0, -7.0, 0.25, 1234567.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounding.general(F.col("v"))).collect()]
    assert got == [None if v is None else f"{v:g}" for v in values]
    assert str(rounding.general(F.col("v"))).count("format_string") <= 11


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (2048, "2 KB"), (5 << 20, "5 MB"), (3 << 30, "3.0 GB")])
def test_file_sizes(spark, n, want):
    assert one(spark, rounding.file_size(F.lit(n))) == want


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n\nHello\n42\nthere\n\n2\n00:00:03,000 --> x\nBye\n"
    cues = [tuple(c) for c in one(spark, text_units.srt_cues(F.lit(srt)))]
    assert cues == [("00:00:01,000", "Hello there"), ("00:00:03,000", "Bye")]
    vtt = "WEBVTT\nKind: x\n00:01.000 --> 00:02.000\nFirst\n\nid\n00:03.000 --> 00:04.000\n42"
    assert [tuple(c) for c in one(spark, text_units.vtt_cues(F.lit(vtt)))] == [("00:01.000", "First"), ("00:03.000", "42")]
    ass = "[Script Info]\nDialogue: no\n[Events]\nDialogue: 0,0:00:01.00,x,S,,0,0,0,,{\\i1}Hi,\\Nyou\nComment: z\n[Fonts]\nDialogue: 0,1,2,3,4,5,6,7,8,late"
    assert [tuple(c) for c in one(spark, text_units.ass_cues(F.lit(ass)))] == [("0:00:01.00", "Hi, you")]
    many = F.array(*[F.struct(F.lit("t").alias("start"), F.lit(str(i)).alias("text")) for i in range(51)])
    out = one(spark, text_units.transcript(many))
    assert out.startswith("<!-- Block 1 --> <!-- t -->\n\n0\n1") and "\n\n<!-- Block 2 --> <!-- t -->\n\n50" in out


def test_cards(spark):
    deck = "intro\n---\n**Q**: one?\n**A**: yes\nmore\n---\nnone"
    assert [tuple(c) for c in one(spark, text_units.cards(F.lit(deck)))] == [("one?", "yes\nmore")]
    table = "x\n| a | b |\n|---|---|\n| 1 |  |\n| 2 | 3 |\ny"
    assert one(spark, text_units.tables_as_bullets(F.lit(table))) == "x\n- **a**: 1\n- **a**: 2, **b**: 3\ny"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9000), min_size=1, max_size=60))
def test_batches_keep_to_their_limits(spark, sizes):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, i int, n int")
    got = sorted((r["i"], r["batch"]) for r in text_units.batches(rows, "g", "i", "n").collect())
    batches: dict[int, list[int]] = {}
    for i, b in got:
        batches.setdefault(b, []).append(sizes[i])
    assert [b for _, b in got] == sorted(b for _, b in got)
    assert all(len(x) <= 20 and (sum(x) <= 8000 or len(x) == 1) for x in batches.values())


def test_pi_constant():
    assert geo.BD_ANGLE == pytest.approx(math.pi * 50 / 3)
