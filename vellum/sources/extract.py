"""A3/A4: text extraction from file bytes, dispatched by extension.

``extract_text(files)`` runs one ``mapInPandas`` job over ``binaryFile`` rows and emits one
row per part ``(path, part_idx, page, text, file_type, error)``: a file that fails or yields
nothing emits a single row with ``error`` set, so one bad file never stops the batch
(``split_dead_letter`` separates the two). Extractors are small per-file functions keyed by
extension; callers register more (PDF, RTF, legacy xls) with ``extractors={ext: fn}``.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import zipfile
from collections.abc import Callable
from html.entities import name2codepoint
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import path_type

Part = tuple[int | None, str]          # (page, text)
Extractor = Callable[[bytes], list[Part]]

_SKIP = {"script", "style", "nav", "noscript", "template", "head", "svg"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr",
          "table", "section", "article", "header", "footer", "aside", "main", "pre",
          "blockquote", "title", "td", "th", "dd", "dt", "hr"}


class _TextOf(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.depth += 1
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def html_text(markup: str | None) -> str:
    """Visible text of an HTML page: script/style/nav/head dropped, entities decoded, one
    line per block element, runs of spaces collapsed, blank lines removed."""
    if not markup:
        return ""
    p = _TextOf()
    try:
        p.feed(markup)
        p.close()
    except Exception:  # noqa: BLE001 - malformed markup: keep what was parsed
        pass
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def _decode(b: bytes) -> str:
    return b.decode("utf-8", errors="replace")


def _plain(b: bytes) -> list[Part]:
    return [(None, _decode(b))]


def _html(b: bytes) -> list[Part]:
    return [(None, html_text(_decode(b)))]


def _csv(b: bytes) -> list[Part]:
    rows = csv.DictReader(io.StringIO(_decode(b)))
    return [(None, "\n".join(f"{k}: {v}" for k, v in r.items())) for r in rows]


def _element_lines(e: ElementTree.Element):
    """One line per element that has text of its own, inline markup joined into it."""
    if (e.text or "").strip() or any((c.tail or "").strip() for c in e):
        yield " ".join("".join(e.itertext()).split())
    else:
        for c in e:
            yield from _element_lines(c)


def _xml_text(b: bytes) -> str:
    return "\n".join(_element_lines(ElementTree.fromstring(b)))


def _xml(b: bytes) -> list[Part]:
    return [(None, _xml_text(b))]


def _json(b: bytes) -> list[Part]:
    json.loads(_decode(b))  # must be valid JSON; the text itself is the part
    return [(None, _decode(b))]


def _zip_members(b: bytes, prefix: str, suffix: str = ".xml") -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = sorted((n for n in z.namelist() if n.startswith(prefix) and n.endswith(suffix)),
                       key=lambda n: (len(n), n))
        return [(n, z.read(n)) for n in names]


def _docx(b: bytes) -> list[Part]:
    (_, body), = _zip_members(b, "word/document.xml")
    root = ElementTree.fromstring(body)
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paras = ["".join(t.text or "" for t in p.iter(ns + "t")) for p in root.iter(ns + "p")]
    return [(None, "\n".join(x for x in paras if x))]


def _paragraphs(root: ElementTree.Element, ns: str) -> str:
    """Paragraphs (``p``), each the texts (``t``) of its runs."""
    paras = ["".join(t.text or "" for t in p.iter(ns + "t")) for p in root.iter(ns + "p")]
    return "\n".join(x for x in paras if x.strip())


def _pptx(b: bytes) -> list[Part]:
    ns = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    return [(i + 1, _paragraphs(ElementTree.fromstring(x), ns))
            for i, (_, x) in enumerate(_zip_members(b, "ppt/slides/slide"))]


def _xlsx(b: bytes) -> list[Part]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def text(e: ElementTree.Element) -> str:  # plain or rich-text runs, without phonetic hints
        return "".join(t.text or "" for x in e if x.tag in (ns + "t", ns + "r") for t in x.iter(ns + "t"))

    shared = _zip_members(b, "xl/sharedStrings.xml")
    strings = [text(si) for si in ElementTree.fromstring(shared[0][1]).iter(ns + "si")] if shared else []
    parts = []
    for i, (_, x) in enumerate(_zip_members(b, "xl/worksheets/sheet")):
        cells = []
        for c in ElementTree.fromstring(x).iter(ns + "c"):
            v, inline = c.find(ns + "v"), c.find(ns + "is")
            if inline is not None:
                cells.append(text(inline))
            elif v is not None and v.text is not None:
                cells.append(strings[int(v.text)] if c.get("t") == "s" else v.text)
        parts.append((i + 1, "\n".join(x for x in cells if x)))
    return parts


def _odt(b: bytes) -> list[Part]:
    (_, body), = _zip_members(b, "content.xml")
    return [(None, _xml_text(body))]


def _epub_chapters(z: zipfile.ZipFile) -> list[str]:
    """Member names in reading order: the package's spine without its navigation page; without a
    readable package, the pages by name."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if local(e) == "rootfile")
        base, package = opf.rpartition("/")[0], ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        spine = [items[e.get("idref")] for e in package.iter() if local(e) == "itemref" and e.get("idref") in items]
        names = [posixpath.normpath(posixpath.join(base, unquote(e.get("href", "")))) for e in spine
                 if "nav" not in (e.get("properties") or "").split()]
        found = [n for n in names if n in set(z.namelist())]
        if found:
            return found
    except (KeyError, StopIteration, ElementTree.ParseError):
        pass
    return sorted(n for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm")))


def _epub(b: bytes) -> list[Part]:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        return [(i + 1, html_text(_decode(z.read(n)))) for i, n in enumerate(_epub_chapters(z))]


DEFAULT_EXTRACTORS: dict[str, Extractor] = {
    "txt": _plain, "md": _plain, "yaml": _plain, "yml": _plain, "json": _json,
    "html": _html, "xhtml": _html, "csv": _csv, "xml": _xml, "docx": _docx, "pptx": _pptx,
    "xlsx": _xlsx, "odt": _odt, "epub": _epub,
}


PLAIN_TYPES = ("txt", "md", "yaml", "yml")
HTML_TYPES = ("html", "xhtml")


def extract_text(files: DataFrame, extractors: dict[str, Extractor] | None = None,
                 path: str = "path", content: str = "content",
                 load: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, part_idx, page, text, file_type, error, *keep)`` per extracted part.

    ``load`` fetches contents for files that come without (plain and structured formats apart, so each file is
    read once); ``keep`` names columns that go along, as text.

    Plain-text formats (A3a) and HTML (A3b) are decoded in the JVM (``make_valid_utf8``); only
    the structured formats go through Python. A caller-registered extractor for a plain
    extension takes precedence."""
    table = dict(DEFAULT_EXTRACTORS)
    custom = {k.lower().lstrip("."): v for k, v in (extractors or {}).items()}
    table.update(custom)
    src = files.withColumnRenamed(path, "path").withColumn("file_type", path_type("path"))
    fetch = load or (lambda rows: rows.withColumnRenamed(content, "content"))
    held = lambda rows: fetch(rows).select("path", "content", "file_type", *[F.col(c).cast("string").alias(c) for c in keep])
    native = [t for t in PLAIN_TYPES + HTML_TYPES if t not in custom]
    is_plain = F.col("file_type").isin(native)
    # Invalid UTF-8 becomes U+FFFD (``decode`` would fail the whole job on one bad file).
    txt = F.make_valid_utf8(F.col("content").cast("string"))
    txt = F.when(F.col("file_type").isin(*HTML_TYPES), html_text_column(txt)).otherwise(txt)
    plain = held(src.where(is_plain)).select(
        "path", F.lit(0).alias("part_idx"), F.lit(None).cast("int").alias("page"),
        F.when(F.length(F.trim(txt)) > 0, txt).alias("text"), "file_type",
        F.when(F.length(F.trim(txt)) > 0, F.lit(None).cast("string"))
        .otherwise(F.lit("ValueError: no content")).alias("error"), *keep)
    src = held(src.where(~is_plain))
    schema = ("path string, part_idx int, page int, text string, file_type string, "
              "error string" + "".join(f", `{c}` string" for c in keep))

    def run(batches):
        for pdf in batches:
            out = []
            for p, data, ext, *own in zip(pdf["path"], pdf["content"], pdf["file_type"], *[pdf[c] for c in keep]):
                fn = table.get(ext)
                try:
                    if fn is None:
                        raise ValueError(f"no extractor for '{ext}'")
                    parts = [(pg, t) for pg, t in fn(bytes(data or b"")) if t and t.strip()]
                    if not parts:
                        raise ValueError("no content")
                    out.extend((p, i, pg, t, ext, None, *own) for i, (pg, t) in enumerate(parts))
                except Exception as e:  # noqa: BLE001 - becomes a dead-letter row
                    out.append((p, None, None, None, ext, f"{type(e).__name__}: {e}", *own))
            if not out:
                continue
            yield pd.DataFrame(out, columns=["path", "part_idx", "page", "text", "file_type",
                                             "error", *keep]).astype({"part_idx": "Int32", "page": "Int32"})

    return plain.unionByName(src.mapInPandas(run, schema))


def split_dead_letter(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (parts, dead letters)."""
    parts = extracted.where(F.col("error").isNull()).drop("error")
    dead = extracted.where(F.col("error").isNotNull()).select("path", "file_type", "error")
    return parts, dead


#: White space that collapses inside a line.
BLANKS = r"[ \t\r\f\x0B\x{00A0}]+"
COMMENT = "(?s)<!--.*?-->"
SKIPPED = [rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>" for t in sorted(_SKIP)]
BLOCK_TAG = rf"(?i)</?({'|'.join(sorted(_BLOCK, key=lambda t: (-len(t), t)))})(\s[^>]*|/)?>"
ANY_TAG = "(?s)<[^>]*>"
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def html_text_column(markup: Column) -> Column:
    """Visible text of an HTML page in built-in functions: comments and script, style, nav, head and
    the like dropped, a line per block element, other tags removed, character references (the
    standard library's table of names, and numbers) decoded, blanks collapsed, empty lines
    removed. NULL gives ''."""
    x = F.coalesce(markup, F.lit(""))
    for pattern in (COMMENT, *SKIPPED):
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(F.regexp_replace(x, BLOCK_TAG, "\n"), ANY_TAG, "")
    names = F.create_map(*[F.lit(v) for name, code in sorted(name2codepoint.items()) for v in (name, chr(code))])

    def decoded(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        code = (F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substring(name, 3, 6), 16, 10))
                .when(F.substring(name, 1, 1) == "#", F.substring(name, 2, 7))).cast("bigint")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        found = F.when(code.isNotNull(), char).when(name != "", F.element_at(names, name))
        rest = piece.substr(F.length(name) + 2, F.length(piece))
        return (F.when(i == 0, piece).when(found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), piece)))

    x = F.array_join(F.transform(F.split(x, "&"), decoded), "")
    lines = F.transform(F.split(x, "\n"), lambda t: F.btrim(F.regexp_replace(t, BLANKS, " ")))
    return F.array_join(F.filter(lines, lambda t: t != ""), "\n")


def html_to_text(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """A3b on a table of pages: ``(key, text)``, in the JVM."""
    return pages.select(key, html_text_column(F.col(markup)).alias("text"))


def _numbered(rows: DataFrame, file_type: str) -> DataFrame:
    """Parts of the rows ``(path, text)`` of files, numbered from 0 in each file.

    Rows keep their place through ``monotonically_increasing_id``; a row's number is its distance from the first row of its
    file in its task plus the rows of earlier tasks of the file (a count per file and task), so a
    large file is numbered by all tasks that read it."""
    from pyspark.sql import Window
    placed = rows.withColumn("_o", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_o", 33))
    tasks = placed.groupBy("path", "_task").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("path", "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["path", "_task"]).select(
        "path", (F.col("_before") + F.col("_o") - F.col("_first")).cast("int").alias("part_idx"),
        F.lit(None).cast("int").alias("page"), "text", F.lit(file_type).alias("file_type"))


def _csv_text(header: list[str], row: list[str]) -> str:
    """``column: value`` lines; values that a row lacks are empty, those beyond the header are left out."""
    return "\n".join(f"{name}: {row[k] if k < len(row) else ''}" for k, name in enumerate(header))


def _csv_files(batches):
    """(path, content) of whole files to (path, part_idx, text) of their rows."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = (r for r in csv.reader(io.StringIO(_decode(bytes(content or b"")).removeprefix("\ufeff"), newline="")) if r)
            header, out = next(rows, []), []
            for k, r in enumerate(rows):
                out.append((path, k, _csv_text(header, r)))
                if len(out) == 2000:
                    yield pd.DataFrame(out, columns=["path", "part_idx", "text"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["path", "part_idx", "text"])


def _csv_lines(batches):
    """(path, part_idx, text, header) of single lines to (path, part_idx, text)."""
    for pdf in batches:
        own = {h: next(csv.reader([h.removeprefix("\ufeff")]), []) for h in pdf["header"].unique()}
        pdf["text"] = [_csv_text(own[h], next(csv.reader([t]), [])) for h, t in zip(pdf["header"], pdf["text"], strict=True)]
        yield pdf[["path", "part_idx", "text"]]


def csv_rows_to_parts(spark, path: str, multiline: bool = True) -> DataFrame:
    """One part per row of the UTF-8 CSV files under ``path``, text = ``column: value`` lines with the columns of the
    row's own file (the first row of each file is its header). ``part_idx`` follows the row order within each file; empty
    rows are none.

    Quoted values may hold line breaks, so a file is parsed by one task. With ``multiline=False`` the caller says
    that none does: then lines are rows, and a large file is read by as many tasks as its size asks for."""
    if multiline:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        rows = files.mapInPandas(_csv_files, "path string, part_idx int, text string")
    else:
        lines = spark.read.text(path).where(F.col("value") != "").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        numbered = _numbered(lines, "csv").select("path", "part_idx", "text")
        headers = numbered.where("part_idx = 0").select("path", F.col("text").alias("header"))  # a row per file
        rows = (numbered.where("part_idx > 0").join(headers, "path").select("path", (F.col("part_idx") - 1).alias("part_idx"), "text", "header")
                .mapInPandas(_csv_lines, "path string, part_idx int, text string"))
    return rows.select("path", "part_idx", F.lit(None).cast("int").alias("page"), "text", F.lit("csv").alias("file_type"))


def xml_rows_to_parts(spark, path: str, row_tag: str) -> DataFrame:
    """A3d with Spark's XML reader when the record element is known: one part per
    ``row_tag`` element, text = ``field: value`` lines of its scalar fields."""
    df = spark.read.format("xml").option("rowTag", row_tag).load(path)
    fields = [f.name for f in df.schema.fields
              if f.dataType.typeName() not in ("struct", "array", "map")]
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"),
                                                                      F.lit(""))) for c in fields])
    return _numbered(df.select(F.input_file_name().alias("path"), text.alias("text")), "xml")
