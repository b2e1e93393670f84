"""Images of pages kept as files, packages with missing files, tables with images, regions of figures."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from siltstone.functions import shapes
from siltstone.operators import layout, manifests, packages
from siltstone.sources import html_tree, office

from .test_sources import EPUB, zipped

GIF = "data:image/gif;base64,R0lGODlhAQABAAAAACw="
IMAGES = f'''<p>a &amp; b
<img src="pics/a%20b.png" alt="x &lt; y"><IMG SRC='https://e.org/i.jpg?x=1'/>
<img alt=none><img src="{GIF}"><!-- <img src="no.png"> --><img data-src="pics/a%20b.png" src="l.gif"></p>'''


def test_places_of_images():
    got = [(p["place"], p["kind"], p["path"], p["name"]) for p in html_tree.image_places(IMAGES, "/base")]
    assert got == [(1, "local", "/base/pics/a b.png", "image_001.png"), (2, "remote", "https://e.org/i.jpg?x=1", "image_002.jpg"), (3, "data", None, "image_003.gif"), (4, "local", "/base/l.gif", "image_004.gif")]
    assert html_tree.image_places(IMAGES)[2]["data"].startswith(b"GIF89a")
    assert html_tree.image_places(IMAGES, web=True)[3]["name"] == "image_001.png"  # one name for equal sources
    assert html_tree.image_places("") == [] and html_tree.image_places("<img src='data:nothing'>")[0]["data"] is None
    assert html_tree.image_places("<img src='file:///x/a%20b'>", "/base")[0]["path"] == "/x/a b"


def test_sources_are_rewritten_and_nothing_else():
    assert html_tree.rewritten_images(IMAGES, {}) == IMAGES
    got = html_tree.rewritten_images(IMAGES, {1: "m/1.png", 2: "m/2.jpg"})
    assert got == IMAGES.replace("pics/a%20b.png", "m/1.png", 1).replace("<IMG SRC='https://e.org/i.jpg?x=1'/>", '<img src="m/2.jpg"/>')
    assert html_tree.rewritten_images(IMAGES, {4: "m"}, web=True).endswith('--><img src="m"></p>')
    dropped = html_tree.rewritten_images(IMAGES, {3: "m"}, drop=True)
    assert dropped == '<p>a &amp; b\n\n<img alt=none><img src="m"><!-- <img src="no.png"> --></p>'


def test_images_of_pages(spark):
    pages = spark.createDataFrame([(1, "/base", IMAGES, "k"), (2, None, None, "k"), (3, "/base", "<img src=gone.png>", None)], "page int, folder string, html string, place string")
    files = spark.createDataFrame([("/base/pics/a b.png",), ("/base/pics/a b.png",), ("/other",)], "path string")
    out, kept = manifests.placed_images(pages, files, "media")
    rows = {r["page"]: r for r in out.collect()}
    assert out.columns == pages.columns and len(rows) == 3 and rows[2]["html"] is None and rows[3]["html"] == "<img src=gone.png>"
    assert rows[1]["html"] == html_tree.rewritten_images(IMAGES, {1: "media/image_001.png", 3: "media/image_003.gif"})
    assert sorted((r["page"], r["name"], r["data"] is None) for r in kept.collect()) == [(1, "image_001.png", True), (1, "image_003.gif", False)]
    out, _ = manifests.placed_images(pages, files.limit(0), "media", drop=True)
    assert {r["page"]: r["html"] for r in out.collect()}[3] == ""
    empty, none = manifests.placed_images(pages.limit(0), files, "media")
    assert empty.count() == none.count() == 0


def test_packages_lose_items_without_files(spark):
    content, removed = office.sane_epub(EPUB)
    assert removed == ["gone.xhtml"] and office.epub_documents(content) == office.epub_documents(EPUB)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        opf = z.read("O/c.opf").decode()
        assert "gone" not in opf and opf.count('idref="a"') == 2 and "Book" in opf
    assert office.sane_epub(content) == (content, []) and office.sane_epub(b"no archive") == (b"no archive", [])
    encoded = zipped({"META-INF/container.xml": '<c><rootfile full-path="c.opf"/></c>', "c.opf": '<package><manifest><item id="a" href="a%20b.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>', "a b.xhtml": "<p/>"})
    assert office.sane_epub(encoded) == (encoded, []) and office.epub_documents(encoded) == ["a b.xhtml"]
    rows = spark.createDataFrame([(1, EPUB), (2, None)], "id int, content binary").withColumn("sane", packages.sane_package("content"))
    assert {r["id"]: r["sane"]["removed"] for r in rows.collect()} == {1: ["gone.xhtml"], 2: None}


def test_tables_with_images():
    cell = "<tc><p><r><t>{}</t></r></p></tc>"
    body = f"<tbl><tr>{cell.format('a')}{cell.format('b')}</tr></tbl><p/><tbl><tr><tc><p><r><drawing/></r></p></tc></tr></tbl>"
    got = list(office.docx_tables(zipped({"word/document.xml": f"<document><body>{body}</body></document>"})))
    assert [(t["table"], t["rows"], t["has_media"]) for t in got] == [(0, 1, False), (1, 1, True)] and "| a | b |" in got[0]["markdown"]


def test_regions_of_figures(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    captions = spark.createDataFrame([(1, 1, 7, (100.0, 300.0, 200.0, 310.0)), (1, 3, 8, (0.0, 10.0, 50.0, 20.0))], f"doc int, page int, caption int, bbox {box}")
    drawn = [(1, (100.0, 200.0, 200.0, 280.0)), (1, (500.0, 700.0, 550.0, 750.0)), (2, (0.0, 0.0, 50.0, 50.0)), (2, (55.0, 0.0, 90.0, 50.0)), (2, (300.0, 300.0, 310.0, 310.0)), (3, (0.0, 100.0, 9.0, 109.0))]
    drawings = spark.createDataFrame([(1, p, b) for p, b in drawn], f"doc int, page int, bbox {box}")
    page = shapes.rect(F.lit(0), F.lit(0), F.lit(600), F.lit(800))
    got = sorted((r["page"], r["kind"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in layout.figure_regions(captions, drawings, page).collect())
    assert got == [
        (1, "captioned", 90.0, 190.0, 210.0, 290.0),
        (2, "cluster", 0.0, 0.0, 90.0, 50.0), (2, "cluster", 300.0, 300.0, 310.0, 310.0), (3, "cluster", 0.0, 100.0, 9.0, 109.0),
    ]
    assert layout.figure_regions(captions.limit(0), drawings.limit(0), page).count() == 0


def test_backgrounds_of_figures(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    captions = spark.createDataFrame([(1, p, p, (100.0, 300.0, 200.0, 310.0)) for p in (1, 2)], f"doc int, page int, caption int, bbox {box}")
    drawings = spark.createDataFrame([(1, p, (100.0, 200.0, 200.0, 280.0)) for p in (1, 2)], f"doc int, page int, bbox {box}")
    # Too large, half of the region, fitting twice; on the third page nothing but a background.
    behind = [(1, 1, (0.0, 0.0, 600.0, 300.0)), (1, 2, (100.0, 200.0, 150.0, 280.0)), (1, 3, (90.0, 195.0, 210.0, 285.0)), (1, 4, (95.0, 195.0, 205.0, 285.0)), (3, 1, (5.0, 5.0, 60.0, 60.0))]
    backgrounds = spark.createDataFrame([(1, p, o, b) for p, o, b in behind], f"doc int, page int, ord int, bbox {box}")
    page = shapes.rect(F.lit(0), F.lit(0), F.lit(600), F.lit(800))
    got = sorted((r["page"], r["kind"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in layout.figure_regions(captions, drawings, page, backgrounds=backgrounds).collect())
    assert got == [(1, "captioned", 80.0, 185.0, 220.0, 295.0), (2, "captioned", 90.0, 190.0, 210.0, 290.0), (3, "cluster", 5.0, 5.0, 60.0, 60.0)]
