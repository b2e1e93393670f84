"""Markdown as columns: statistics, cleaning, list items, emphasis and links (AGG-02/03, TXT-*, WIN-05).

Lines are arrays inside a row, so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s+"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"
SEPARATOR_ROW = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
#: The marks of unordered items, and the months that footers name.
BULLETS = "•●○◦▪▸►"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONOSPACE = (
    "courier", "consolas", "monaco", "menlo", "monospace", "source code", "fira code", "jetbrains", "inconsolata", "dejavu sans mono",
    "liberation mono", "ubuntu mono", "roboto mono", "robotomono", "sf mono", "cascadia", "hack",
)
STRUCTURAL = r"^(?:\*\*)?(?:问题\s*\d*|回复|收\s*件\s*人|发\s*件\s*人|邮\s*箱|日\s*期|电\s*话|编\s*号|总\s*页\s*数|主\s*题|标段编号)"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body names it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines of a text; a line feed at the end doesn't begin another one, and an empty text has none."""
    def trimmed(parts: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return once(F.split(text, "\r\n|\n|\r", -1), trimmed)


def count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def runs(flags: Column) -> Column:
    """The number of runs of true values in an array of booleans."""
    return once(flags, lambda f: F.size(F.filter(f, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(f, F.greatest(i - 1, F.lit(0))), F.lit(False))))))


def is_table_line(line: Column) -> Column:
    s = F.trim(line)
    return (s.startswith("|") & s.endswith("|")) | s.rlike(SEPARATOR_ROW)


def statistics(text: Column) -> Column:
    """Struct of line_count, char_count, heading_count, table_count, image_ref_count, link_count."""
    t = F.coalesce(text, F.lit(""))

    def of(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("line_count"),
            F.length(t).alias("char_count"),
            count_lines(lines, HEADING).alias("heading_count"),
            runs(F.transform(lines, is_table_line)).alias("table_count"),
            F.regexp_count(t, F.lit(IMAGE)).alias("image_ref_count"),
            F.regexp_count(t, F.lit(LINK)).alias("link_count"),
        )

    return once(lines_of(t), of)


def collapse_blank(text: Column) -> Column:
    """Lines without trailing white space, and one empty line for each run of blank ones (WIN-05)."""
    stripped = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return once(stripped, lambda s: F.array_join(F.filter(s, lambda x, i: (x != "") | (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0))) != "")), "\n"))


def strip_images(text: Column) -> Column:
    """Without image references; lines that only held some go, and runs of blank lines become one (TXT-06/07)."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(
        F.transform(lines, lambda x: F.struct(x.alias("old"), F.regexp_replace(x, IMAGE, "").alias("new"))),
        lambda s: ~(s["old"].rlike(IMAGE) & (F.trim(s["new"]) == "")),
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["new"]), "\n"), r"\n{3,}", "\n\n")


def image_names(text: Column) -> Column:
    """The file names that image references point to, in order (TXT-09)."""
    targets = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)
    return F.transform(targets, lambda x: F.regexp_extract(F.regexp_replace(F.trim(x), r"[?#].*$", ""), r"([^/\\]*)$", 1))


def html_images(text: Column) -> Column:
    """``<img>`` as Markdown images, with the alternative text wherever it stands (TXT-05, defect D8 mended)."""
    alt_first = r'(?i)<img\b[^>]*?\balt="([^"]*)"[^>]*?\bsrc="([^"]+)"[^>]*>'
    src_first = r'(?i)<img\b[^>]*?\bsrc="([^"]+)"[^>]*?\balt="([^"]*)"[^>]*>'
    bare = r'(?i)<img\b[^>]*?\bsrc="([^"]+)"[^>]*>'
    out = F.regexp_replace(F.regexp_replace(text, alt_first, "![$1]($2)"), src_first, "![$2]($1)")
    return F.regexp_replace(out, bare, "![]($1)")


def merge_emphasis(text: Column) -> Column:
    """Emphasis that ends and begins again at once becomes one phrase (TXT-15)."""
    return F.regexp_replace(F.regexp_replace(text, r"\*{6}", " "), r"\*{4}", " ")


def space_after_labels(text: Column) -> Column:
    """A space between an emphasised label and what follows (TXT-16)."""
    for stars in (3, 2):
        text = F.regexp_replace(text, rf"(\*{{{stars}}}[^\n*]+[:：;；,，、。]\*{{{stars}}})(?=[\u3400-\u9fffA-Za-z0-9])", "$1 ")
    return text


def emphasis(text: Column, flags: Column) -> Column:
    """Bold (flag 16) and italic (flag 2) marks around a text; an empty one stays empty (TXT-12)."""
    s = F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    mark = F.concat(F.when(flags.bitwiseAND(16) != 0, "**").otherwise(""), F.when(flags.bitwiseAND(2) != 0, "*").otherwise(""))
    return F.when(s == "", "").otherwise(F.concat(mark, s, mark))


def list_item(text: Column) -> Column:
    """Struct is_list, kind (ul, ol or null) and content with a uniform mark (TXT-13)."""
    s = F.trim(text)
    bullet = rf"^(?:[{BULLETS}]\s*|[-–—]\s+|\*\s+)"
    numbered = r"^(\d+)[.、)]\s*"
    ul, ol = s.rlike(bullet), s.rlike(numbered)
    content = F.when(ul, F.concat(F.lit("- "), F.regexp_replace(s, bullet, ""))).when(ol, F.regexp_replace(s, numbered, "$1. ")).otherwise(s)
    return F.struct((ul | ol).alias("is_list"), F.when(ul, "ul").when(ol, "ol").alias("kind"), content.alias("content"))


def without_page_footer(text: Column) -> Column:
    """Without a month, year and page number at the end (TXT-14)."""
    out = F.regexp_replace(text, rf"(?i)\s*(?:{MONTHS})\s+\d{{4}}\s+\d{{1,3}}\s*$", "")
    return F.rtrim(F.regexp_replace(out, r"\s*\d{4}年\d{1,2}月\s+\d{1,3}\s*$", ""))


def heading_level(size: Column, body: Column, h1: Column, h2: Column, h3: Column, text: Column, flags: Column, strict: bool = True) -> Column:
    """0 for body text, else 1 to 3 by font size, with the rules for length, sentences and boldness (MTH-16)."""
    by_size = F.when(size >= h1 - 0.5, 1).when(size >= h2 - 0.5, 2).when(size >= h3 - 0.5, 3).otherwise(0)
    if not strict:
        return by_size
    s = F.trim(text)
    sentence = s.rlike(r"[.。!！?？]$") & ~s.rlike(r"^[\d第]+[.、章节]")
    weak = (flags.bitwiseAND(16) == 0) & (by_size >= 2) & (size < F.coalesce(body, F.lit(12.0)) + 2)
    return F.when((by_size > 0) & (F.coalesce(text, F.lit("")) != "") & ((F.length(s) > 80) | sentence | weak), 0).otherwise(by_size)


def is_monospace(font: Column) -> Column:
    """Whether a font's name tells that it is monospace (FLT-17)."""
    f = F.lower(F.coalesce(font, F.lit("")))
    return F.exists(F.array(*[F.lit(m) for m in MONOSPACE]), lambda m: f.contains(m))


def is_sentence_end(text: Column) -> Column:
    """Whether a text ends a sentence; a blank one does (FLT-18)."""
    return (F.trim(text) == "") | text.rlike(r"[.。!！?？:：;；]\s*$")


def is_structural_label(text: Column) -> Column:
    return F.trim(text).rlike(STRUCTURAL)


def is_caption(text: Column) -> Column:
    """Whether a line begins like a figure's caption (FLT-34)."""
    return F.trim(text).rlike(r"(?i)^(?:Figure|Fig\.)\s*\d+\s*[:.]")


def is_translatable(text: Column) -> Column:
    """Not blank, not only symbols and digits, not a URL or an address (FLT-08)."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return (s != "") & ~s.rlike(r"(?U)^[\W\d_]+$") & ~s.rlike(r"(?U)^(?:https?://\S+|[\w.-]+@[\w.-]+)$")


def placeholder_error(text: Column, tags: Column) -> Column:
    """A code if the marks [t:0], [t:1], ... aren't all there in order, else null (TXT-29)."""
    found = F.regexp_extract_all(text, F.lit(r"\[t:\d+\]"), 0)
    want = F.when(tags > 0, F.transform(F.sequence(F.lit(0), F.greatest(tags - 1, F.lit(0))), lambda i: F.concat(F.lit("[t:"), i.cast("string"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.when(found == want, F.lit(None).cast("string")).otherwise("placeholders")


def collapse_lines(text: Column) -> Column:
    """White space within lines collapsed, blank lines gone (TXT-17)."""
    lines = F.transform(F.split(text, "\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def inline(text: Column) -> Column:
    """White space collapsed to single spaces (TXT-18)."""
    return F.regexp_replace(text, r"\s+", " ")


def table_cell(text: Column) -> Column:
    """A cell that can stand between pipes; an empty one is a space (TXT-22)."""
    return F.coalesce(F.nullif(F.replace(collapse_lines(text), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit(" "))


def escape_cell(text: Column) -> Column:
    """Backslashes and pipes escaped, line breaks as ``<br>`` (SNK-12, SNK-18)."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\r\n|\r", "\n"), r"\s*\n\s*", "<br>"))


def link_label(text: Column) -> Column:
    """Brackets and backslashes of a link's label escaped (TXT-19)."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def safe_url(url: Column) -> Column:
    """The trimmed URL, or null for an empty one or a scheme that runs or reads things (FLT-22)."""
    s = F.trim(url)
    return F.when((s != "") & ~F.lower(s).rlike("^(javascript|data|vbscript|file):"), s)


def list_ready(text: Column) -> Column:
    """An empty line before lists, and nesting by four spaces (TXT-27)."""
    out = F.regexp_replace(text, r"([^\n])\n(\s*[-*]\s)", "$1\n\n$2")
    out = F.regexp_replace(out, r"([^\n])\n(\s*\d+\.\s)", "$1\n\n$2")
    return F.regexp_replace(out, r"(?m)^\s{2,3}([-*])", "    $1")


def unescape(text: Column) -> Column:
    """Backslashes before harmless punctuation gone, but kept where ``1.`` would begin a list (TXT-11)."""
    return F.regexp_replace(F.regexp_replace(text, r"\\([(){}!,:;\"'/-])", "$1"), r"(?m)(?<!^\d{1,3})\\\.", ".")


def reference_name(target: Column) -> Column:
    """The file that an image reference's target names, without angle brackets, title or quotes."""
    s = F.trim(target)
    place = F.when(s.startswith("<"), F.regexp_extract(s, r"^<([^>]*)", 1)).otherwise(F.regexp_replace(F.regexp_extract(s, r"^(\S*)", 1), "^[\"']+|[\"']+$", ""))
    return F.regexp_extract(place, r"([^/]*)/*$", 1)


def strip_named_images(text: Column, names: Column) -> Column:
    """Without the references to files of an array of names; lines that only held some go, and runs of blank lines become one (TXT-08)."""
    form = r"!\[[^\]]*\]\([^)]*\)"

    def stripped(line: Column) -> Column:
        named = F.filter(F.regexp_extract_all(line, F.lit(form), 0), lambda r: F.array_contains(names, reference_name(F.regexp_extract(r, r"\(([^)]*)\)$", 1))))
        return F.aggregate(named, line, lambda acc, r: F.replace(acc, r, F.lit("")))

    lines = F.transform(lines_of(text), lambda x: F.struct(x.alias("old"), stripped(x).alias("new")))
    kept = F.filter(lines, lambda s: (F.trim(s["old"]) == "") | (F.trim(s["new"]) != ""))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["new"]), "\n"), r"\n{3,}", "\n\n")


#: What stays as it is in a link's target, besides letters, digits and ``_.-~``; the percent sign last.
TARGET_SAFE = "/:?=&#@!$'+,;%"


def link_target(target: Column) -> Column:
    """A link's target, percent-encoded but for what separates its parts (TXT-20)."""
    out = F.replace(F.replace(F.url_encode(F.trim(target)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    for c in TARGET_SAFE:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def link(label: Column, target: Column) -> Column:
    """A Markdown link (TXT-21)."""
    return F.concat(F.lit("["), link_label(label), F.lit("]("), link_target(target), F.lit(")"))


def tsv_field(html: Column) -> Column:
    """HTML as one field of a TSV line: line breaks as spaces, in code as ``<br>``, tabs as four spaces (TXT-28)."""
    code = r"(?s)<pre><code.*?</code></pre>"
    blocks = F.transform(F.regexp_extract_all(html, F.lit(code), 0), lambda b: F.replace(b, F.lit("\n"), F.lit("<br>")))
    between = F.transform(F.split(html, code, -1), lambda p: F.regexp_replace(p, "\r\n|\r|\n", " "))
    whole = F.array_join(F.zip_with(between, blocks, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(F.replace(whole, F.lit("\t"), F.lit("    ")), r"^\s+|\s+$", "")


def with_section(text: Column, heading: str, entries: Column) -> Column:
    """The text with a section of further paragraphs at its end; as it is without any."""
    section = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n\n## {heading}\n\n"), F.array_join(entries, "\n\n"), F.lit("\n"))
    return F.when(F.size(entries) > 0, section).otherwise(text)


def with_vectors(text: Column, folder: Column, names: Column) -> Column:
    """The text with a section of those vector files of a folder that it doesn't refer to; numbers follow the sorted names (TXT-38)."""
    numbered = F.transform(F.array_sort(names), lambda n, i: F.struct(F.concat(folder, F.lit("/"), n).alias("path"), (i + 1).alias("n")))
    missing = F.filter(numbered, lambda x: ~F.contains(text, x["path"]))
    return with_section(text, "Extracted Office Vector Assets", F.transform(missing, lambda x: F.concat(F.lit("![Office vector "), x["n"].cast("string"), F.lit("]("), x["path"], F.lit(")"))))


def titled(title: Column, content: Column) -> Column:
    """A Markdown file's text: a title and its content (SNK-20)."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), content, F.lit("\n"))
