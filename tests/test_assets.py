"""Operators of manifests, page Markdown, reports, slides and subtitles, on small cases."""

from __future__ import annotations

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import markdown as md
from siltstone.functions import names, profiles, shapes
from siltstone.operators import checks, layout, manifests, power
from siltstone.sources import office, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_named_images(spark):
    text = '# a\n![x](<p/a b.png>)\nkeep ![y](p/k.png "t") and ![z](q/b.png)\n\n\n![](b.png) ![](p/b.png)\n\nend\n'
    got = one(spark, md.strip_named_images(F.lit(text), F.array(F.lit("a b.png"), F.lit("b.png"))))
    assert got == '# a\nkeep ![y](p/k.png "t") and \n\nend'


@pytest.mark.parametrize("target,want", [("  a b/c?d=é&e=%20#f ", "a%20b/c?d=%C3%A9&e=%20#f"), ("x(y)~[z]+1", "x%28y%29~%5Bz%5D+1"), ("%2F*", "%2F%2A")])
def test_link_targets(spark, target, want):
    from urllib.parse import quote

    assert quote(target.strip(), safe="/:?=&%#@!$'*+,;").replace("*", "%2A") == want
    assert one(spark, md.link_target(F.lit(target))).replace("*", "%2A") == want


def test_fields_keep_code_lines(spark):
    html = "<p>a\r\nb</p><pre><code class='x'>1\n</code></pre>\n<pre><code>l1\n\tl2\n</code></pre>\r<p>end</p>\n"
    got = one(spark, md.tsv_field(F.lit(html)))
    assert got == "<p>a b</p><pre><code class='x'>1<br></code></pre> <pre><code>l1<br>    l2<br></code></pre> <p>end</p>"


def test_paths_in_packages(spark):
    for target, want in (("media/i.png", "word/media/i.png"), ("/word/a//b", "word/a/b"), ("../x%20y+z", "x y+z"), ("../../../q", "q")):
        assert one(spark, names.part_path(F.lit(target))) == want
    assert one(spark, names.target_hash(F.create_map(F.lit("word/a"), F.lit("h")), F.lit(""))) is None


def test_options_and_paths(spark):
    manifests.image_options(True, False)
    with pytest.raises(ValueError):
        manifests.image_options(True, True)
    assert one(spark, names.replaced_path(F.lit("r"), F.lit("a/b.png"), F.lit("o"))) == "o/a/b.png"
    assert one(spark, names.replaced_path(F.lit("r"), F.lit("a/b.png"), F.lit("o"), overwrite=True)) == "r/a/b.png"
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "file string")
    assert [r["file"] for r in manifests.mask_files(rows).collect()] == ["a", "b"]


def test_placeholders_may_be_missing(spark):
    slots = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, tags int")
    rows = spark.createDataFrame([(1, "x [t:5]"), (2, "a [t:0]"), (3, "[t:1] [t:0]"), (4, "?"), (1, " ")], "id int, translation string")
    assert sorted(r["id"] for r in checks.accepted(slots, rows).collect()) == [1, 2]
    with pytest.raises(ValueError, match="3"):
        checks.accepted(slots, rows, allow_missing=False)


def test_page_markdown(spark):
    kinds = [("heading", "# H"), ("list", "- a"), ("list", "- b"), ("text", "t"), ("list", "- c"), ("code", "x = 1"), ("code", "y = 2"), ("table", "| a |"), ("list", "- d"), ("code", "z")]
    rows = spark.createDataFrame([(1, i, k, c) for i, (k, c) in enumerate(kinds)], "page int, nth int, kind string, content string")
    got = layout.page_markdown(rows.repartition(3), ["page"], "nth").first()["markdown"]
    assert got == "# H\n\n- a\n- b\n\nt\n\n- c\n\n```\nx = 1\ny = 2\n```\n\n| a |\n\n- d\n\n```\nz\n```\n\n"


def test_full_report_and_formats(spark):
    rho, d, curve = 1.225, 100.0, [(3.0, 50.0, 0.8), (7.5, 900.0, 0.75), (12.0, 3000.25, None)]
    rows = spark.createDataFrame([("c", i, *r) for i, r in enumerate(curve)], "k string, i int, wind double, power double, ct double")
    points = power.curve_points(rows, rho, d)
    area = math.pi * d * d / 4
    pw = [0.5 * rho * area * w**3 / 1000 for w, _, _ in curve]
    cps = [p / q for (_, p, _), q in zip(curve, pw, strict=True)]
    best = cps.index(max(cps))
    want = [
        "# Cp 计算结果", "", "## 参数", "", f"- 空气密度 rho：`{rho:g} kg/m^3`", f"- 叶轮直径 D：`{d:g} m`", f"- 扫掠面积 A：`{area:.3f} m^2`", "", "## 最终结果", "", f"- `Cp,max`：`{max(cps):.6f}`",
        f"- 对应风速：`{curve[best][0]:g} m/s`", f"- 对应功率：`{curve[best][1]:.1f} kW`", f"- 对应理论风功率：`{pw[best]:.1f} kW`", f"- 对应 Ct：`{curve[best][2]:.3f}`", "- 异常提示：未发现 Cp 超过贝茨极限 `0.593`。",
        "", "## 明细", "", "| 风速 (m/s) | 功率 (kW) | Ct | 理论风功率 (kW) | Cp |", "|---:|---:|---:|---:|---:|",
    ]
    want += [f"| {w:g} | {p:.1f} | {'' if c is None else f'{c:.3f}'} | {q:.1f} | {x:.4f} |" for (w, p, c), q, x in zip(curve, pw, cps, strict=True)] + [""]
    assert power.full_report(points, "k", "i", rho, d, ct="ct").first()["report"] == "\n".join(want)
    import json

    got = json.loads(power.json_report(points, "k", "i", ct="ct").first()["json"])
    assert [p["ct"] for p in got["points"]] == [0.8, 0.75, None] and got["summary"]["cp_max_ct"] == curve[best][2] and got["summary"]["row_count"] == 3
    for path, explicit, kind in (("a/b.CSV", None, "csv"), ("a.json", "", "json"), ("a.json", "csv", "csv"), (None, None, "markdown"), (".csv", None, "markdown")):
        assert one(spark, power.output_format(F.lit(path).cast("string"), F.lit(explicit).cast("string"))) == kind


def test_drawings(spark):
    page, big = shapes.rect(*map(F.lit, (0, 0, 600, 800))), shapes.rect(*map(F.lit, (0, 0, 400, 100)))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert one(spark, shapes.keep_vector(big, page, none, none, True)) and not one(spark, shapes.keep_vector(big, page, none, F.array(big)))
    assert not one(spark, shapes.keep_vector(shapes.rect(*map(F.lit, (0, 0, 71, 100))), page, none, none))
    assert one(spark, shapes.text_dominant(F.lit(6), big, page)) and not one(spark, shapes.text_dominant(F.lit(5), big, page))


def test_profiles_are_written(spark, tmp_path):
    row = profiles.result(F.lit("in.docx"), F.lit("in.md"), F.lit("doc"), F.lit("docx"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("in.json"))
    profiles.write_json(spark.range(1).select(row.alias("r"), F.lit(None).cast("int").alias("n")), str(tmp_path / "p"))
    text = "".join(f.read_text() for f in (tmp_path / "p").glob("part-*.json"))
    assert '"asset_dir":""' in text and '"source_profile":"in.json"' in text and '"n":null' in text


R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="a" xmlns:p="p"'


def deck() -> bytes:
    def text(x, y, t, link=""):
        run = f'<a:r>{"<a:rPr><a:hlinkClick r:id=" + chr(34) + link + chr(34) + "/></a:rPr>" if link else ""}<a:t>{t}</a:t></a:r>'
        return f'<p:sp><p:spPr><a:off x="{x}" y="{y}"/></p:spPr><p:txBody><a:p>{run}</a:p></p:txBody></p:sp>'

    files = {
        "ppt/presentation.xml": f'<p:presentation {R}><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f'<p:sld {R}><p:cSld><p:spTree>{text(0, 50, "second")}{text(0, 10, "first", "j")}<p:pic><p:blipFill><a:blip r:embed="i"/></p:blipFill><p:spPr><a:off x="0" y="90"/></p:spPr></p:pic></p:spTree></p:cSld></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="j" Target="slide2.xml"/><Relationship Id="i" Target="../media/image1.png"/></Relationships>',
        "ppt/slides/slide2.xml": f"<p:sld {R}><p:cSld><p:spTree/></p:cSld></p:sld>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_slides_as_markdown(spark, tmp_path):
    want = "# My deck\n\n- Source: `My deck.pptx`\n- Total slides: 2\n\n## Slide 1\n\n[first](#slide-2)\n\nsecond\n\n![Slide 1 Image 1](My deck_files/image1.png)\n\n## Slide 2\n\n_No extractable text content._\n"
    assert office.pptx_to_markdown(deck(), "My deck.pptx") == want
    (tmp_path / "deck.pptx").write_bytes(deck())
    row = readers.documents(spark, str(tmp_path)).first()
    assert row["error"] is None and row["markdown"].startswith("# deck\n")


def test_subtitle_folders(spark, tmp_path):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n{}\n"
    for chapter, name, text in (("ch 1", "l10.srt", "ten"), ("ch 1", "l2.srt", "two"), ("ch 1", "empty.srt", ""), ("ch2", "a.vtt", "vee")):
        (tmp_path / chapter).mkdir(exist_ok=True)
        body = srt.format(text).replace(",", ".") if name.endswith("vtt") else srt.format(text)
        (tmp_path / chapter / name).write_text(("WEBVTT\n\n" if name.endswith("vtt") else "") + body)
    got = {r["path"].rpartition("/")[2].replace("%20", " "): r["markdown"] for r in readers.subtitles(spark, str(tmp_path), raw=True, chapters=True).collect()}
    assert got == {"ch 1": "# ch 1\n\n## l2\n\ntwo\n\n## l10\n\nten\n\n", "ch2": "# ch2\n\n## a\n\nvee\n\n"}
    flat = {r["path"].rpartition("/")[2]: r["markdown"] for r in readers.subtitles(spark, str(tmp_path / "ch 1"), raw=True).collect()}
    assert flat == {"l2.srt": "# l2\n\ntwo\n", "l10.srt": "# l10\n\nten\n"}
