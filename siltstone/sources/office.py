"""Office files, notebooks and packages from their bytes, with the standard library.

(SRC-25 to SRC-34, SRC-40 to SRC-42, TXT-23 to TXT-25, TXT-34 to TXT-37, HTM-14 to HTM-17, SNK-36, SNK-38, FLT-11.)
Each reader takes the content of one file, so files are dealt out like rows.
"""

from __future__ import annotations

import base64
import datetime
import io
import json
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

from . import html_tree


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if not names or local(c.tag) in names]


def _first(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((x for x in ([] if e is None else e.iter()) if local(x.tag) == name and x is not e), None)


def _attr(e: ET.Element | None, name: str, default: str = "") -> str:
    return default if e is None else next((v for k, v in e.attrib.items() if local(k) == name), default)


def safe_entries(z: zipfile.ZipFile) -> list[str]:
    """Names of an archive that stay inside the folder it is unpacked to."""
    return [n for n in z.namelist() if not n.startswith(("/", "\\")) and not re.match(r"[A-Za-z]:", n) and ".." not in re.split(r"[/\\]", n)]


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets by id of a part, as names in the archive."""
    folder, name = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    out = {}
    for r in _children(root, "Relationship"):
        target = _attr(r, "Target")
        out[_attr(r, "Id")] = target if _attr(r, "TargetMode") == "External" else target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return out


# Worksheets


def _column(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return int(row), n


def _date_styles(z: zipfile.ZipFile) -> dict[int, bool]:
    root = _xml(z, "xl/styles.xml")
    custom = {int(_attr(f, "numFmtId", "0")): _attr(f, "formatCode") for f in ([] if root is None else root.iter()) if local(f.tag) == "numFmt"}
    out = {}
    for i, xf in enumerate(_children(_first(root, "cellXfs"), "xf")):
        k = int(_attr(xf, "numFmtId", "0"))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(k, ""))
        out[i] = 14 <= k <= 22 or 45 <= k <= 47 or bool(re.search(r"[dmyhs]", code, re.I))
    return out


def xlsx_cells(content: bytes) -> Iterator[dict]:
    """Cells in long form: sheet, state, row, col, value as text, and kind (text, number, bool, date or error)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in _children(_xml(z, "xl/sharedStrings.xml"), "si")]
        dates, targets = _date_styles(z), _relations(z, "xl/workbook.xml")
        for sheet in _children(_first(_xml(z, "xl/workbook.xml"), "sheets"), "sheet"):
            root = _xml(z, targets.get(_attr(sheet, "id"), ""))
            if root is None:
                continue
            at = {"sheet": _attr(sheet, "name"), "state": _attr(sheet, "state") or "visible"}
            for c in (e for e in root.iter() if local(e.tag) == "c"):
                row, col = _column(_attr(c, "r"))
                kind, v = _attr(c, "t"), next((x.text for x in c if local(x.tag) == "v"), None)
                if kind == "inlineStr":
                    v, kind = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t"), "text"
                elif v is None:
                    continue
                elif kind == "s":
                    v, kind = shared[int(v)], "text"
                elif kind == "b":
                    v, kind = ("TRUE" if v == "1" else "FALSE"), "bool"
                elif kind == "e":
                    kind = "error"
                elif kind == "str":
                    kind = "text"
                elif dates.get(int(_attr(c, "s") or 0)):
                    v, kind = _excel_date(float(v)), "date"
                else:
                    x = float(v)
                    v, kind = (str(int(x)) if x.is_integer() and "." not in v and "E" not in v.upper() else f"{x:g}"), "number"
                yield {**at, "row": row, "col": col, "value": v, "kind": kind}


def _excel_date(serial: float) -> str:
    if 0 <= serial < 1:
        return (datetime.datetime(1900, 1, 1) + datetime.timedelta(days=serial)).time().isoformat("seconds")
    t = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(serial * 86400))
    return t.isoformat(" ", "seconds")


def xlsx_merges(content: bytes) -> Iterator[dict]:
    """Merged ranges: sheet, row0, col0, row1, col1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = _relations(z, "xl/workbook.xml")
        for sheet in _children(_first(_xml(z, "xl/workbook.xml"), "sheets"), "sheet"):
            root = _xml(z, targets.get(_attr(sheet, "id"), ""))
            for m in ([] if root is None else root.iter()):
                if local(m.tag) == "mergeCell":
                    a, _, b = _attr(m, "ref").partition(":")
                    (r0, c0), (r1, c1) = _column(a), _column(b or a)
                    yield {"sheet": _attr(sheet, "name"), "row0": r0, "col0": c0, "row1": r1, "col1": c1}


# Slides


def pptx_shapes(content: bytes) -> Iterator[dict]:
    """Leaf shapes of all slides in reading order: slide, ord, kind (text, table, picture or note), top, left, text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = _slides(z)
        jumps = {part: f"#slide-{n}" for n, part in enumerate(parts, 1)}  # a link to a slide is one to its heading
        for number, part in enumerate(parts, 1):
            root = _xml(z, part)
            links = {k: jumps.get(t, t) for k, t in _relations(z, part).items()}
            rows = sorted(_leaves(_first(root, "spTree"), links), key=lambda r: (r["top"], r["left"]))
            note = next((t for t in links.values() if "notesSlide" in t), "")
            text = "\n".join(_paragraphs(_xml(z, note), {}, "body")) if note in z.namelist() else ""
            if text:
                rows.append({"kind": "note", "top": 0, "left": 0, "text": text})
            for i, r in enumerate(rows):
                yield {"slide": number, "ord": i, **r}


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The parts of a presentation's slides, in order."""
    targets = _relations(z, "ppt/presentation.xml")
    refs = _children(_first(_xml(z, "ppt/presentation.xml"), "sldIdLst"), "sldId")
    return [targets.get(next((v for k, v in ref.attrib.items() if k.endswith("}id")), ""), "") for ref in refs]


def pptx_to_markdown(content: bytes, name: str) -> str:
    """A presentation as Markdown: a heading per slide, its texts, tables and pictures in reading order, and notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        count = len(_slides(z))
    rows = list(pptx_shapes(content))
    stem = name.rpartition(".")[0] or name
    out, pictures = [f"# {stem}", f"- Source: `{name}`\n- Total slides: {count}"], 0
    for number in range(1, count + 1):
        blocks, note = [], ""
        for r in (r for r in rows if r["slide"] == number):
            if r["kind"] == "note":
                note = r["text"]
            elif r["kind"] != "picture":
                blocks.append(r["text"])
            else:
                pictures += 1
                blocks.append(f"![Slide {number} Image {pictures}]({stem}_files/{r['text'].rpartition('/')[2]})")
        out += [f"## Slide {number}", *(blocks or ["_No extractable text content._"])]
        out += ["### Speaker Notes", note] if note else []
    return "\n\n".join(out).strip() + "\n"


def _leaves(tree: ET.Element | None, links: dict[str, str]) -> Iterator[dict]:
    for e in _children(tree, "sp", "pic", "graphicFrame", "grpSp"):
        if local(e.tag) == "grpSp":
            yield from sorted(_leaves(e, links), key=lambda r: (r["top"], r["left"]))
            continue
        off = _first(e, "off")
        at = {"top": int(_attr(off, "y") or 0), "left": int(_attr(off, "x") or 0)}
        if local(e.tag) == "pic":
            yield {"kind": "picture", **at, "text": links.get(_attr(_first(e, "blip"), "embed"), "")}
        elif (table := _first(e, "tbl")) is not None:
            rows = [[" ".join(_paragraphs(c, links)) for c in _children(r, "tc")] for r in _children(table, "tr")]
            yield {"kind": "table", **at, "text": markdown_table(rows)}
        elif text := _list(e, links):
            yield {"kind": "text", **at, "text": text}


def _runs(p: ET.Element, links: dict[str, str]) -> str:
    out: list[tuple[str | None, str]] = []
    for r in _children(p, "r", "br", "fld"):
        url = links.get(_attr(_first(r, "hlinkClick"), "id"))
        text = "\n" if local(r.tag) == "br" else "".join(t.text or "" for t in r.iter() if local(t.tag) == "t")
        if out and out[-1][0] == url:
            out[-1] = (url, out[-1][1] + text)
        else:
            out.append((url, text))
    return "".join(f"[{t}]({u})" if u and t.strip() and not re.match(r"(?i)\s*(javascript|data|vbscript|file):", u) else t for u, t in out).strip()


def _paragraphs(e: ET.Element | None, links: dict[str, str], kind: str | None = None) -> list[str]:
    shapes = [e] if kind is None else [s for s in ([] if e is None else e.iter()) if local(s.tag) == "sp" and _attr(_first(s, "ph"), "type") == kind]
    return [t for s in shapes if s is not None for p in s.iter() if local(p.tag) == "p" and (t := _runs(p, links))]


def _list(e: ET.Element, links: dict[str, str]) -> str:
    ps = [(int(_attr(_first(p, "pPr"), "lvl") or 0), t) for p in e.iter() if local(p.tag) == "p" and (t := _runs(p, links))]
    if len(ps) > 1 and any(level for level, _ in ps):
        return "\n".join("  " * level + "- " + t for level, t in ps)
    return "\n".join(t for _, t in ps)


def markdown_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    cells = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") or " " for c in r + [""] * (width - len(r))] for r in rows]
    return "\n".join(["| " + " | ".join(r) + " |" for r in cells[:1]] + ["| " + " | ".join(["---"] * width) + " |"] + ["| " + " | ".join(r) + " |" for r in cells[1:]]) if width else ""


# Documents and formulas

ACCENTS = {"̂": r"\hat", "̃": r"\tilde", "̅": r"\bar", "⃗": r"\vec", "̇": r"\dot"}
NARY = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}


def omml_to_latex(e: ET.Element | str) -> str:
    """A formula of Office Math as LaTeX."""
    if isinstance(e, str):
        e = ET.fromstring(e)
    part = {local(c.tag): c for c in e}

    def tex(name: str) -> str:
        return "".join(omml_to_latex(c) for c in part.get(name, ()))

    def prop(name: str, default: str = "") -> str:
        pr = next((c for k, c in part.items() if k.endswith("Pr")), None)
        found = _first(pr, name) if pr is not None else None
        return default if found is None else _attr(found, "val", default)

    kind = local(e.tag)
    if kind == "t":
        return e.text or ""
    if kind == "f":
        return rf"\frac{{{tex('num')}}}{{{tex('den')}}}"
    if kind == "rad":
        return rf"\sqrt[{tex('deg')}]{{{tex('e')}}}" if tex("deg") else rf"\sqrt{{{tex('e')}}}"
    if kind == "sSup":
        return f"{{{tex('e')}}}^{{{tex('sup')}}}"
    if kind == "sSub":
        return f"{{{tex('e')}}}_{{{tex('sub')}}}"
    if kind == "sSubSup":
        return f"{{{tex('e')}}}_{{{tex('sub')}}}^{{{tex('sup')}}}"
    if kind == "nary":
        sign = prop("chr", "∫")
        low, high = tex("sub"), tex("sup")
        return NARY.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f" {tex('e')}"
    if kind == "d":
        inner = prop("sepChr", "|").join("".join(omml_to_latex(c) for c in x) for x in e if local(x.tag) == "e")
        return rf"\left{prop('begChr', '(') or '.'}{inner}\right{prop('endChr', ')') or '.'}"  # a side without a bracket is a point
    if kind == "m":
        rows = [" & ".join("".join(omml_to_latex(c) for c in x) for x in _children(r, "e")) for r in _children(e, "mr")]
        return r"\begin{matrix} " + r" \\ ".join(rows) + r" \end{matrix}"
    if kind == "eqArr":
        return r"\begin{aligned} " + r" \\ ".join("".join(omml_to_latex(c) for c in x) for x in _children(e, "e")) + r" \end{aligned}"
    if kind in ("limLow", "limUpp"):
        return f"{{{tex('e')}}}{'_' if kind == 'limLow' else '^'}{{{tex('lim')}}}"
    if kind == "sPre":
        return f"{{}}_{{{tex('sub')}}}^{{{tex('sup')}}}{{{tex('e')}}}"
    if kind == "groupChr":
        return tex("e")
    if kind == "acc":
        return f"{ACCENTS.get(prop('chr', '̂'), ACCENTS['̂'])}{{{tex('e')}}}"
    if kind == "bar":
        return rf"\{'underline' if prop('pos') == 'bot' else 'overline'}{{{tex('e')}}}"
    if kind == "func":
        return rf"\{tex('fName').strip()}{{{tex('e')}}}" if tex("fName").strip().isalpha() else f"{tex('fName')}{{{tex('e')}}}"
    if kind.endswith("Pr"):
        return ""
    return "".join(omml_to_latex(c) for c in e)


def docx_to_markdown(content: bytes) -> str:
    """Headings, lists, emphasis, links, tables and formulas of a document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body, links = _first(_xml(z, "word/document.xml"), "body"), _relations(z, "word/document.xml")
        out = [t for e in _children(body, "p", "tbl") if (t := _docx_table(e, links) if local(e.tag) == "tbl" else _docx_paragraph(e, links))]
    return "\n\n".join(out)


def _docx_inline(p: ET.Element, links: dict[str, str]) -> str:
    out = []
    for r in p:
        kind = local(r.tag)
        if kind == "hyperlink":
            inner, url = _docx_inline(r, links), links.get(_attr(r, "id"), "")
            out.append(f"[{inner}]({url})" if url and inner else inner)
        elif kind in ("oMath", "oMathPara"):
            out.append(f"${omml_to_latex(r)}$")
        elif kind == "r":
            text = "".join("\t" if local(t.tag) == "tab" else " " if local(t.tag) in ("br", "cr") else t.text or "" for t in r if local(t.tag) in ("t", "tab", "br", "cr"))
            pr = _first(r, "rPr")
            mark = "".join(m for n, m in (("b", "**"), ("i", "*")) if any(local(x.tag) == n and _attr(x, "val", "1") not in ("0", "false") for x in _children(pr)))
            out.append(f"{mark}{text.strip()}{mark}" if mark and text.strip() else text)
        elif kind in ("ins", "smartTag", "sdt", "sdtContent"):
            out.append(_docx_inline(r, links))
    return "".join(out)


def _docx_paragraph(p: ET.Element, links: dict[str, str]) -> str:
    text, style = _docx_inline(p, links).strip(), _attr(_first(_first(p, "pPr"), "pStyle"), "val")
    if not text:
        return ""
    if m := re.fullmatch(r"(?:Heading|heading |标题)\s*([1-6])", style):
        return f"{'#' * int(m[1])} {text}"
    if style == "Title":
        return f"# {text}"
    number = _first(_first(p, "pPr"), "numPr")
    return f"{'  ' * int(_attr(_first(number, 'ilvl'), 'val') or 0)}- {text}" if number is not None else text


def _docx_table(t: ET.Element, links: dict[str, str]) -> str:
    rows = [["<br>".join(x for p in _children(c, "p") if (x := _docx_inline(p, links).strip())) for c in _children(r, "tc")] for r in _children(t, "tr")]
    return markdown_table(rows)


def has_media(table: ET.Element) -> bool:
    """Whether an image stands anywhere in a table (FLT-27)."""
    return any(local(e.tag) in ("drawing", "imagedata") for e in table.iter())


def docx_tables(content: bytes) -> Iterator[dict]:
    """The tables of a document's body in order: table (from 0), rows, has_media, markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body, links = _first(_xml(z, "word/document.xml"), "body"), _relations(z, "word/document.xml")
        for i, t in enumerate(_children(body, "tbl")):
            yield {"table": i, "rows": len(_children(t, "tr")), "has_media": has_media(t), "markdown": _docx_table(t, links)}


def ipynb_to_markdown(text: str) -> str:
    """Markdown cells as they are, code cells in fences with their text output; attachments keep their names."""
    book = json.loads(text)
    language = book.get("metadata", {}).get("language_info", {}).get("name", "python")
    out = []
    for cell in book.get("cells", []):
        source = "".join(cell["source"]) if isinstance(cell.get("source"), list) else cell.get("source", "")
        if cell.get("cell_type") == "markdown":
            out.append(re.sub(r"\(attachment:([^)]+)\)", r"(\1)", source))
        elif cell.get("cell_type") == "code":
            out.append(f"```{language}\n{source}\n```")
            for o in cell.get("outputs", []):
                data = o.get("text") or o.get("data", {}).get("text/plain")
                if data:
                    out.append("```\n" + ("".join(data) if isinstance(data, list) else data).rstrip() + "\n```")
        else:
            out.append(source)
    return "\n\n".join(x for x in out if x.strip())


def ipynb_attachments(text: str) -> dict[str, bytes]:
    return {name: base64.b64decode(b) for cell in json.loads(text).get("cells", []) for name, kinds in cell.get("attachments", {}).items() for b in kinds.values()}


# EPUB

BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "blockquote", "figcaption", "caption", "div", "section", "article", "aside"}
UNTOUCHED = {"script", "style", "code", "pre", "kbd", "samp", "var", "math", "svg"}
XHTML = ' xmlns="http://www.w3.org/1999/xhtml"'


def opf_path(z: zipfile.ZipFile) -> str:
    return _attr(_first(_xml(z, "META-INF/container.xml"), "rootfile"), "full-path")


def epub_documents(content: bytes) -> list[str]:
    """Texts of a package in reading order, each once, then the navigation and NCX; missing files are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        opf, entries = opf_path(z), set(safe_entries(z))
        root = _xml(z, opf)
        items = {_attr(i, "id"): i for i in ([] if root is None else root.iter()) if local(i.tag) == "item"}

        def path(i: ET.Element) -> str:
            return posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(_attr(i, "href").partition("#")[0])))

        spine = [items[r] for x in root.iter() if local(x.tag) == "itemref" and (r := _attr(x, "idref")) in items]
        more = [i for i in items.values() if "nav" in _attr(i, "properties").split()] + [i for i in items.values() if "ncx" in _attr(i, "media-type")]
        return [p for p in dict.fromkeys(path(i) for i in spine + more) if p in entries]


def epub_to_markdown(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [html_tree.to_markdown(z.read(n).decode("utf-8", "replace")) for n in epub_documents(content) if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(p for p in parts if p)


def is_translatable(text: str | None) -> bool:
    s = (text or "").strip()
    return bool(s) and not re.fullmatch(r"[\W\d_]+", s) and not re.fullmatch(r"https?://\S+|[\w.-]+@[\w.-]+", s)


def _tags(e: ET.Element) -> list[str]:
    """Opening and closing tag of an element as text; one tag if it is empty."""
    bare = ET.Element(e.tag, dict(e.attrib))
    if not len(e) and not e.text:
        return [ET.tostring(bare, encoding="unicode").replace(XHTML, "")]
    bare.text = "\0"
    return ET.tostring(bare, encoding="unicode").replace(XHTML, "").split("\0")


def _with_placeholders(block: ET.Element) -> tuple[str, list[str]]:
    parts, tags = [block.text or ""], []

    def mark(tag: str) -> None:
        parts.append(f"[t:{len(tags)}]")
        tags.append(tag)

    def add(e: ET.Element) -> None:
        ends = _tags(e)
        mark(ends[0])
        if len(ends) == 2:
            parts.append(e.text or "")
            for c in e:
                add(c)
            mark(ends[1])
        parts.append(e.tail or "")

    for c in block:
        add(c)
    return "".join(parts), tags


def text_slots(xml: str) -> Iterator[dict]:
    """Texts to translate: innermost blocks first (with placeholders for inner tags), then loose texts and tails.

    Rows: path (child numbers from the root), attribute (block, text or tail), source, tags.
    """
    ET.register_namespace("", "http://www.w3.org/1999/xhtml")
    done: set[int] = set()
    root = ET.fromstring(xml)

    def blocks(e: ET.Element, path: list[int]) -> Iterator[dict]:
        name = local(e.tag).lower()
        if name in UNTOUCHED:
            return
        inner = any(local(c.tag).lower() in BLOCKS for c in e.iter() if c is not e)
        if name in BLOCKS and not inner and any(is_translatable(x.text) or (x is not e and is_translatable(x.tail)) for x in e.iter()):
            done.update(id(x) for x in e.iter())
            source, tags = _with_placeholders(e)
            yield {"path": path, "attribute": "block", "source": source, "tags": tags}
            return
        for i, c in enumerate(e):
            yield from blocks(c, [*path, i])

    def loose(e: ET.Element, path: list[int], skip: bool, within: bool) -> Iterator[dict]:
        skip = skip or local(e.tag).lower() in UNTOUCHED
        own = id(e) in done
        if not skip and not own and is_translatable(e.text):
            yield {"path": path, "attribute": "text", "source": e.text, "tags": []}
        for i, c in enumerate(e):
            yield from loose(c, [*path, i], skip, own)
            if not skip and not own and is_translatable(c.tail):
                yield {"path": [*path, i], "attribute": "tail", "source": c.tail, "tags": []}

    yield from blocks(root, [])
    yield from loose(root, [], False, False)


def named_slots(xml: str, name: str) -> Iterator[dict]:
    """Texts of elements of one name: ``text`` in an NCX, ``title`` in a package's metadata."""

    def visit(e: ET.Element, path: list[int]) -> Iterator[dict]:
        if local(e.tag).lower() == name and is_translatable(e.text):
            yield {"path": path, "attribute": "text", "source": e.text, "tags": []}
        for i, c in enumerate(e):
            yield from visit(c, [*path, i])

    yield from visit(ET.fromstring(xml), [])


def apply_slots(xml: str, translations: list[dict]) -> str:
    """The document with translations (path, attribute, tags, translation) put in their places."""
    ET.register_namespace("", "http://www.w3.org/1999/xhtml")
    root = ET.fromstring(xml)

    def at(path: list[int]) -> ET.Element:
        e = root
        for i in path:
            e = list(e)[i]
        return e

    for t in translations:
        e = at(t["path"])
        if t["attribute"] in ("text", "tail"):
            setattr(e, t["attribute"], t["translation"])
            continue
        tags = t["tags"]
        escaped = t["translation"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        inner = re.sub(r"\[t:(\d+)\]", lambda m: tags[int(m[1])], escaped)
        new = ET.fromstring(f"<x{XHTML if '{http://www.w3.org/1999/xhtml}' in e.tag else ''}>{inner}</x>")
        for c in list(e):
            e.remove(c)
        e.text = new.text
        e.extend(list(new))
    return ET.tostring(root, encoding="unicode")


def epub_slots(content: bytes) -> Iterator[dict]:
    """All slots of a package with ids in document order: slot_id, document, path, attribute, source, tags."""
    n = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in [*epub_documents(content), opf_path(z)]:
            xml = z.read(name).decode("utf-8-sig")
            found = named_slots(xml, "title") if name.endswith(".opf") else named_slots(xml, "text") if name.endswith(".ncx") else text_slots(xml)
            for s in found:
                n += 1
                yield {"slot_id": f"t{n:06d}", "document": name, **s}


def rebuilt_epub(content: bytes, replaced: dict[str, str], language: str | None = None) -> bytes:
    """The package with replaced texts: mimetype first and stored, images stored, the rest deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as new:
        names = sorted(safe_entries(z), key=lambda n: n != "mimetype")
        opf = opf_path(z)
        for n in names:
            data = replaced[n].encode() if n in replaced else z.read(n)
            if n == opf and language:
                data = re.sub(rb"(<dc:language[^>]*>)[^<]*(</dc:language>)", rb"\g<1>" + language.encode() + rb"\g<2>", data)
            stored = n == "mimetype" or n.lower().endswith((".jpg", ".jpeg", ".png", ".gif", ".webp"))
            new.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def sane_epub(content: bytes) -> tuple[bytes, list[str]]:
    """The package without manifest items whose file is missing, nor their places in the spine, and the hrefs that went (SRC-31).

    A package that lacks nothing, or can't be read, is returned as it is.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            opf, entries = opf_path(z), set(z.namelist())
            root = _xml(z, opf)
        manifest = _first(root, "manifest")
        broken = [i for i in _children(manifest, "item") if (h := _attr(i, "href")) and posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(h))) not in entries]
        if not broken:
            return content, []
        ids, spine = {_attr(i, "id") for i in broken} - {""}, _first(root, "spine")
        for i in broken:
            manifest.remove(i)
        for x in [x for x in _children(spine, "itemref") if _attr(x, "idref") in ids]:
            spine.remove(x)
        for prefix, space in (("", "http://www.idpf.org/2007/opf"), ("dc", "http://purl.org/dc/elements/1.1/")):
            ET.register_namespace(prefix, space)
        xml = '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="unicode")
        return rebuilt_epub(content, {opf: xml}), [_attr(i, "href") for i in broken]
    except (zipfile.BadZipFile, ET.ParseError, KeyError):
        return content, []


# Images


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + (0 if 0xD0 <= kind <= 0xD9 or kind in (0x01, 0xFF) else struct.unpack(">H", data[at + 2 : at + 4])[0])
    return None


def decode_subtitle(data: bytes) -> str:
    """UTF-8, else GBK, else Latin-1 (SRC-14)."""
    for encoding in ("utf-8-sig", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")
