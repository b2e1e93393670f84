"""Parsers on small files made here."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.sources import geofiles, html_tree, office, readers


def archive(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BOOK = zipped(
    {
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><r><t>a|</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>N</t></is></c></row><row><c r="B3" t="s"><v>1</v></c><c r="C3"><v>2.5</v></c></row>'
        '<row><c r="B4" t="b"><v>1</v></c><c r="C4"><v>7</v></c><c r="D4" s="1"><v>45292</v></c></row></sheetData><mergeCells><mergeCell ref="B4:B5"/></mergeCells></worksheet>',
    }
)


def test_worksheet():
    cells = {(c["row"], c["col"]): (c["value"], c["kind"]) for c in office.xlsx_cells(BOOK)}
    assert cells[2, 2] == ("Name", "text") and cells[3, 2] == ("a|b", "text") and cells[3, 3] == ("2.5", "number")
    assert cells[4, 2] == ("TRUE", "bool") and cells[4, 3] == ("7", "number") and cells[4, 4] == ("2024-01-01 00:00:00", "date")
    assert list(office.xlsx_merges(BOOK)) == [{"sheet": "S", "row0": 4, "col0": 2, "row1": 5, "col1": 2}]


def test_readers_make_rows_of_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(BOOK)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = readers.xlsx_cells(spark, str(tmp_path)).collect()
    assert len(rows) == 7 and all(r["path"].endswith("a.xlsx") for r in rows)
    (tmp_path / "n.md").write_text("# hi")
    (tmp_path / "x.bin").write_bytes(b"?")
    got = {r["path"].rpartition("/")[2]: (r["markdown"], r["error"]) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["n.md"] == ("# hi", None) and got["x.bin"] == (None, "no reader for .bin")


def test_document_with_formula_and_table():
    w = 'xmlns:w="w" xmlns:m="m"'
    doc = zipped(
        {
            "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>'
            "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space='preserve'> x </w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p>"
            "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
        }
    )
    assert office.docx_to_markdown(doc) == "## Top\n\n**bold** x $\\frac{1}{2}$\n\n| a | b |\n| --- | --- |"


def test_formulas():
    m = 'xmlns:m="m"'
    assert office.omml_to_latex(f'<m:oMath {m}><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>') == "{x}^{2}"
    assert office.omml_to_latex(f'<m:rad {m}><m:deg/><m:e><m:r><m:t>y</m:t></m:r></m:e></m:rad>') == r"\sqrt{y}"
    assert office.omml_to_latex(f'<m:nary {m}><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>a</m:t></m:r></m:e></m:nary>') == r"\sum_{i} a"


def test_slides():
    a, p = 'xmlns:a="a"', 'xmlns:p="p"'
    shape = lambda y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    deck = zipped(
        {
            "ppt/presentation.xml": f'<p:presentation {p} {R}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
            "ppt/slides/slide1.xml": f"<p:sld {p} {a}><p:cSld><p:spTree>{shape(9, 'low')}{shape(1, 'high')}</p:spTree></p:cSld></p:sld>",
        }
    )
    assert [(s["ord"], s["text"]) for s in office.pptx_shapes(deck)] == [(0, "high"), (1, "low")]


PAGE = '<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>One</h1><div><p>Two <b>bold</b> end</p>loose<code>no</code></div></body></html>'
EPUB = zipped(
    {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>',
        "O/c.opf": '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:language>en</dc:language></metadata><manifest><item id="a" href="a.xhtml"/><item id="gone" href="gone.xhtml"/></manifest>'
        '<spine><itemref idref="a"/><itemref idref="gone"/><itemref idref="a"/></spine></package>',
        "O/a.xhtml": PAGE,
        "../evil": "x",
    }
)


def test_package():
    assert office.epub_documents(EPUB) == ["O/a.xhtml"]
    slots = list(office.epub_slots(EPUB))
    assert [(s["slot_id"], s["attribute"], s["source"]) for s in slots] == [("t000001", "block", "One"), ("t000002", "block", "Two [t:0]bold[t:1] end"), ("t000003", "tail", "loose"), ("t000004", "text", "Book")]
    done = office.apply_slots(PAGE, [{**slots[1], "translation": "Zwei [t:0]fett[t:1] & Ende"}, {**slots[2], "translation": "los"}])
    assert "<p>Zwei <b>fett</b> &amp; Ende</p>los<code>" in done
    with zipfile.ZipFile(io.BytesIO(office.rebuilt_epub(EPUB, {"O/a.xhtml": done}, "de"))) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "../evil" not in z.namelist() and b">de<" in z.read("O/c.opf")


def test_notebook():
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"], "attachments": {"i.png": {"image/png": "AAAA"}}}, {"cell_type": "code", "source": "1+1", "outputs": [{"data": {"text/plain": ["2"]}}]}]})
    assert office.ipynb_to_markdown(book) == "# T\n\n```python\n1+1\n```\n\n```\n2\n```"
    assert office.ipynb_attachments(book) == {"i.png": b"\0\0\0"}


@pytest.mark.parametrize(
    "data",
    [b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 5), b"GIF89a" + struct.pack("<HH", 7, 5), b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -5), b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 7) + b"\0" * 8],
)
def test_image_sizes(data):
    assert tuple(office.image_size(data)) == (7, 5)
    assert office.image_size(data[:8]) is None


def test_decoding():
    assert [office.decode_subtitle(x) for x in ("é".encode(), "标题".encode("gbk"), b"\xff\xff")] == ["é", "标题", "ÿÿ"]


def test_html():
    assert html_tree.to_markdown("<h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x<li>y</ul><script>no</script>") == "# T\n\na **b**[c](u)\n\n- x\n- y"
    assert html_tree.to_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert html_tree.to_text("<p>a &lt;b&gt;</p><style>x</style>c") == "a <b>\nc"
    body = "word " * 60
    assert html_tree.content_markdown(f"<body><nav>menu</nav><article>{body}</article></body>") == body.strip()
    meta = html_tree.metadata('<title>News - 某政府网</title><meta name="author" content="A">', "https://x/202401/t20_1.html")
    assert (meta["title"], meta["date"], meta["author"]) == ("News", "2024-01", "A")
    assert html_tree.images('<img data-src="l.png" src="s.png" alt="x">') == [{"src": "l.png", "alt": "x"}]
    assert html_tree.data_uri("data:image/jpeg;base64,AAAA") == (".jpg", b"\0\0\0")


def test_unclosed_tags_end_with_their_parents():
    root = html_tree.parse("<div><p>a<b>b</p>c</div></span>d")
    assert html_tree.node_to_markdown(root).split() == ["a**b**", "cd"]


def test_coordinate_files(spark):
    f = geofiles.transform("wgs84", "gcj02")
    lon, lat = f(116.0, 39.0)
    text, n, bad = geofiles.rewrite("id,lon,lat\n1,116.0,39.0\n2,,1\n3,x,1\nshort\n", "csv", "wgs84", "gcj02")
    assert (n, bad) == (1, 1) and text.splitlines()[1] == f"1,{lon},{lat}" and text.splitlines()[3] == "3,x,1"
    text, n, _ = geofiles.rewrite('{"type":"LineString","coordinates":[[116.0,39.0,5],[0,0]]}', "geojson", "wgs84", "gcj02")
    assert n == 2 and json.loads(text)["coordinates"] == [[lon, lat, 5], [0, 0]]
    text, n, _ = geofiles.rewrite('<gpx xmlns="g"><wpt lat="39.0" lon="116.0"/></gpx>', "gpx", "wgs84", "gcj02")
    assert n == 1 and f'lon="{lon}"' in text
    text, n, _ = geofiles.rewrite("<kml><coordinates>116.0,39.0,1 bad</coordinates></kml>", "kml", "wgs84", "gcj02")
    assert n == 1 and f"{lon},{lat},1 bad" in text
    rows = spark.createDataFrame([("<kml/>", "kml"), ("{", "geojson")], "t string, k string").select(geofiles.rewritten(F.col("t"), F.col("k"), "gps", "baidu").alias("r")).select("r.*").collect()
    assert [r["error"] is None for r in rows] == [True, False] and rows[1]["text"] == "{"
    kml = '<kml xmlns="k"><Point><coordinates> 1,2,3 4,5 </coordinates></Point></kml>'
    assert [tuple(p) for p in spark.range(1).select(geofiles.kml_points(F.lit(kml))).first()[0]] == [(1.0, 2.0), (4.0, 5.0)]


@pytest.mark.parametrize("tag", ["p", "li", "b", "div", "td", "blockquote"])
def test_deep_pages(tag):
    """Open elements by the thousand, with and without an end."""
    for page in (f"<{tag}>x " * 20000, f"<{tag}>" * 20000 + "x" + f"</{tag}>" * 20000, f"</{tag}>" * 20000 + "x"):
        assert "x" in html_tree.to_text(page)
        assert "x" in html_tree.to_markdown(page)
        assert "x" in html_tree.content_markdown(f"<body>{page}")
        assert html_tree.metadata(page, "u")["title"] == "Untitled"


def test_implied_ends():
    assert html_tree.to_markdown("<p>a<p>b<div>c</div><ul><li>x<ul><li>y</ul><li>z</ul>") == "a\n\nb\n\nc\n- x\n- y\n- z"
    assert html_tree.to_markdown("<table><tr><td>1<td>2<tr><td>3<td>4</table>") == "| 1 | 2 |\n| --- | --- |\n| 3 | 4 |"
    assert html_tree.to_text("<p>a<table><tr><td><p>b<p>c</table>d").split() == ["a", "b", "c", "d"]


def test_containers_of_content_systems():
    text = "long enough to count as content " * 8
    for mark in ('class="x TRS_Editor"', 'class="pages_content"', 'id="Zoom"', 'class="TYS-main-zt-show"', 'class="info-content"'):
        page = f"<body><div>{'menu ' * 40}</div><div {mark}><span>{text}</span></div></body>"
        assert html_tree.content_markdown(page) == text.strip()


@pytest.mark.parametrize(
    "text,url,date",
    [
        ("发布时间： 2024年3月5日 来源：X", "", "2024-3-5"), ("时间:2023/1/2 日期：2022-12-31", "", "2022-12-31"), ("2021年10月01日 发布", "", "2021-10-01"),
        ("2021-10-01 来源", "", "2021-10-01"), ("nothing", "https://x/202405/t20240501_1.html", "2024-05"), ("nothing", "https://x/2024/05/06/a", "2024-05-06"), ("日期：soon", "", ""),
    ],
)
def test_page_dates(text, url, date):
    meta = html_tree.metadata(f"<body>{text}</body>", url)
    assert meta["date"] == date


def test_page_sources_and_titles():
    assert html_tree.metadata("<p>来源： 新华社 发布单位：B", "")["author"] == "新华社"
    assert html_tree.metadata("<p>发布机构：市政府<br>", "")["author"] == "市政府"
    assert html_tree.site_free_title("A - B | 中国政府网 x") == "A" and html_tree.site_free_title("A-B") == "A-B"


def test_unreadable_files_can_be_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(BOOK)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = readers.xlsx_cells(spark, str(tmp_path), errors=True).collect()
    bad = [r for r in rows if r["error"]]
    assert len(rows) == 8 and len(bad) == 1 and bad[0]["path"].endswith("broken.xlsx") and bad[0]["row"] is None


@pytest.mark.parametrize(
    "inner,latex",
    [
        ("<m:limLow><m:e><m:r><m:t>lim</m:t></m:r></m:e><m:lim><m:r><m:t>x</m:t></m:r></m:lim></m:limLow>", "{lim}_{x}"),
        ("<m:limUpp><m:e><m:r><m:t>a</m:t></m:r></m:e><m:lim><m:r><m:t>b</m:t></m:r></m:lim></m:limUpp>", "{a}^{b}"),
        ("<m:sPre><m:sub><m:r><m:t>a</m:t></m:r></m:sub><m:sup><m:r><m:t>b</m:t></m:r></m:sup><m:e><m:r><m:t>X</m:t></m:r></m:e></m:sPre>", "{}_{a}^{b}{X}"),
        ("<m:eqArr><m:e><m:r><m:t>a</m:t></m:r></m:e><m:e><m:r><m:t>b</m:t></m:r></m:e></m:eqArr>", r"\begin{aligned} a \\ b \end{aligned}"),
        ("<m:bar><m:barPr><m:pos m:val='bot'/></m:barPr><m:e><m:r><m:t>u</m:t></m:r></m:e></m:bar>", r"\underline{u}"),
        ("<m:bar><m:barPr><m:pos m:val='top'/></m:barPr><m:e><m:r><m:t>u</m:t></m:r></m:e></m:bar>", r"\overline{u}"),
        ("<m:d><m:dPr><m:begChr m:val='{'/><m:endChr m:val=''/></m:dPr><m:e><m:r><m:t>c</m:t></m:r></m:e></m:d>", r"\left{c\right."),
        ("<m:groupChr><m:e><m:r><m:t>g</m:t></m:r></m:e></m:groupChr>", "g"),
        ("<m:m><m:mr><m:e><m:r><m:t>1</m:t></m:r></m:e><m:e><m:r><m:t>2</m:t></m:r></m:e></m:mr></m:m>", r"\begin{matrix} 1 & 2 \end{matrix}"),
    ],
)
def test_more_formulas(inner, latex):
    assert office.omml_to_latex(f"<m:oMath xmlns:m='m'>{inner}</m:oMath>") == latex


def test_geojson_positions_of_all_geometries(spark):
    text = json.dumps(
        {
            "type": "FeatureCollection", "bbox": [0, 0, 9, 9],
            "features": [
                {"type": "Feature", "properties": {"v": [7, 8], "s": '"coordinates": [5, 5]'}, "geometry": {"type": "Point", "coordinates": [1, 2.5, 100]}},
                {"geometry": {"type": "LineString", "coordinates": [[3, 4], [-5.25, 6e1]]}},
                {"geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 1], [2, 1], [1, 1]]]]}},
                {"geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [8, 9]}]}},
                {"geometry": {"type": "Point", "coordinates": []}},
            ],
        }
    )
    df = spark.createDataFrame([(text,), ('{"type": "Point", "coordinates": [1,2]}',), ("{}",), (None,)], "t string")
    got = [r["p"] if r["p"] is None else [tuple(x) for x in r["p"]] for r in df.select(geofiles.geojson_points(F.col("t")).alias("p")).collect()]
    assert got == [[(1, 2.5), (3, 4), (-5.25, 60), (1, 1), (2, 1), (1, 1), (8, 9)], [(1, 2)], [], None]


def test_kml_keeps_its_lines():
    f = geofiles.Counter(lambda x, y: (x + 1, y))
    out = geofiles.rewrite_kml("<kml><coordinates>\n  1,2,0\n  3,4\n  x\n</coordinates></kml>", f)
    assert "<coordinates>\n  2.0,2.0,0\n  4.0,4.0\n  x\n</coordinates>" in out and f.points == 2


def test_boxes_are_painted_in_order(spark):
    from siltstone.operators import layout

    px = spark.createDataFrame([("a", x, 0, 9, 9, 9) for x in range(5)] + [("b", 0, 0, 1, 2, 3)], "k string, x int, y int, r int, g int, b int")
    fills = spark.createDataFrame([("a", 2, [1, 0, 3, 1], 2, 2, 2), ("a", 1, [0, 0, 2, 1], 1, 1, 1)], "k string, ord int, box array<int>, r int, g int, b int")
    got = sorted(tuple(r) for r in layout.filled_boxes(px, fills, ["k"]).collect())
    assert got == [("a", 0, 0, 1, 1, 1), ("a", 1, 0, 2, 2, 2), ("a", 2, 0, 2, 2, 2), ("a", 3, 0, 9, 9, 9), ("a", 4, 0, 9, 9, 9), ("b", 0, 0, 1, 2, 3)]


def test_ties_and_limits(spark):
    from siltstone.operators import layout, text_units

    spans = spark.createDataFrame([("d", 12.0, "abcd"), ("d", 10.0, "abcd"), ("d", 20.0, "ab")], "doc string, size double, text string")
    assert tuple(layout.font_sizes(spans).first()) == ("d", 10.0, 20.0, 12.0, None)
    cells = spark.createDataFrame([("s", r, c, "v", "text") for r in range(3) for c in range(2)], "sheet string, row int, col int, value string, kind string")
    assert tuple(layout.table_limits(cells, ["sheet"], 2, 2).first()) == ("s", True, False)
    rows = spark.createDataFrame([(2, "x", 1), (1, "x", 2), (3, None, 3), (4, None, 4), (1, "y", 5)], "o int, t string, extra int")
    assert sorted(r["extra"] for r in text_units.first_of_copies(rows, "t", "o").collect()) == [2, 3, 5]
