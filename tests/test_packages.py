"""Slots over documents, readers of translations, and SQL functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone import sqlfuncs
from siltstone.operators import checks, packages
from siltstone.sources import office, readers

from .test_sources import EPUB, PAGE


def test_slot_ids_go_on_over_documents(spark):
    rows = spark.createDataFrame([("b", d, p) for d in (1, 2) for p in range(3)] + [("c", 1, 0)], "book string, document int, place int")
    got = sorted(tuple(r) for r in packages.slot_ids(rows, "book", "document", "place").select("book", "document", "place", "slot_id").collect())
    assert [r[3] for r in got] == ["t000001", "t000002", "t000003", "t000004", "t000005", "t000006", "t000001"]


def test_documents_are_put_together_again(spark):
    docs = spark.createDataFrame([("a", PAGE), ("b", "<p>keep</p>"), ("bad", "<p>")], "document string, xml string")
    slots = [("a", s["path"], s["attribute"], s["tags"], s["source"].replace("One", "Eins")) for s in office.text_slots(PAGE)] + [("bad", [0], "text", [], "x")]
    rows = spark.createDataFrame(slots, "document string, path array<int>, attribute string, tags array<string>, translation string")
    out = {r["document"]: r for r in packages.translated_documents(docs, rows).collect()}
    assert "<h1>Eins</h1>" in out["a"]["xml"] and "<b>bold</b>" in out["a"]["xml"] and out["b"]["xml"] == "<p>keep</p>" and out["bad"]["error"]


def test_epub_slots_of_a_folder(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(EPUB)
    assert [r["slot_id"] for r in readers.epub_slots(spark, str(tmp_path)).orderBy("slot_id").collect()] == ["t000001", "t000002", "t000003", "t000004"]


def test_translation_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "t1", "source": "a", "translation": "b"}\n\nnot json\n{"translation": "x"}\n{"id": "t2"}\n')
    got = sorted((r["id"] or "", r["error"] or "") for r in readers.translations(spark, str(tmp_path)).collect())
    assert got == [("", "no id"), ("", "not JSON"), ("t1", ""), ("t2", "no translation")]


def test_json_objects(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", "[1]"), ("c", "{")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["path"][-6:]: (r["config"], r["error"]) for r in readers.json_objects(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ('{"x": 1}', None), "b.json": (None, "not an object"), "c.json": (None, "not JSON")}


def test_occurrences_are_matched_one_to_one(spark):
    images = spark.createDataFrame([("d", 0, "h"), ("d", 1, "h"), ("d", 2, "x"), ("d", 3, "z")], "doc string, ord int, hash string")
    places = spark.createDataFrame([("d", 0, "q"), ("d", 1, "h"), ("d", 2, "h")], "doc string, pos int, hash string")
    got = sorted((r["ord"], r["pos"]) if r["pos"] is not None else (r["ord"], -1) for r in checks.matched_occurrences(images, places).collect())
    assert got == [(0, 1), (1, 2), (2, 0), (3, -1)]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    r = spark.sql("SELECT wgs84_to_gcj02(116.397D, 39.909D) AS p, cp(3D, 186.4D, 1.02D, 220D) AS c, overlap_ratio(0,0,10,10,5,5,20,20) AS o, html_to_text('<p>a</p>') AS t").first()
    from siltstone.sources.geofiles import transform

    assert (r["p"]["lon"], r["p"]["lat"]) == pytest.approx(transform("wgs84", "gcj02", 12)(116.397, 39.909), abs=1e-9)
    assert r["c"] == pytest.approx(0.3561, abs=1e-4) and r["o"] == 0.25 and r["t"] == "a"
    assert spark.range(1).select(F.expr("wgs84_to_gcj02(2.0D, 48.0D).lon")).first()[0] == 2.0
