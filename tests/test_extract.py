"""Office formats, names and numbering: one case per fault found in review."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions.metadata import metadata_scalars
from vellum.sources import extract as X
from vellum.sources.files import scan_corpus
from vellum.sources.keywords import load_keywords


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_xlsx_rich_text_and_inline_strings():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = zipped({
        "xl/sharedStrings.xml": f"<sst {ns}><si><r><t>rich</t></r><r><t>text</t></r></si><si><t>budget</t></si><si><t/></si><si><t>vendor</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>3</v></c>'
                                    f'<c t="inlineStr"><is><t>inline</t></is></c><c><v>7</v></c></row></sheetData></worksheet>'})
    assert X._xlsx(book) == [(1, "richtext\nbudget\nvendor\ninline\n7")]


def test_inline_markup_does_not_split_words():
    assert X._xml_text(b"<d><p>con<b>tract</b> law</p><p>next</p><q><r>one</r><r>two</r></q></d>") == "contract law\nnext\none\ntwo"
    odt = zipped({"content.xml": '<o xmlns:t="urn:t"><t:p>con<t:span>tract</t:span></t:p><t:h><t:span>head</t:span></t:h></o>'})
    assert X._odt(odt) == [(None, "contract\nhead")]


def test_epub_follows_the_spine():
    book = zipped({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
        "OPS/p.opf": '<package><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="z" href="a%20z.xhtml"/><item id="a" href="b.xhtml"/>'
                     '</manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="z"/></spine></package>',
        "OPS/nav.xhtml": "<p>contents</p>", "OPS/a z.xhtml": "<p>second</p>", "OPS/b.xhtml": "<p>first</p>"})
    assert X._epub(book) == [(1, "first"), (2, "second")]
    assert X._epub(zipped({"b.html": "<p>b</p>", "a.html": "<p>a</p>"})) == [(1, "a"), (2, "b")]


def test_csv_ids_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("k,v\n" + "".join(f"{i},z\n" for i in range(500)))
    rows = X.csv_rows_to_parts(spark, str(tmp_path)).orderBy("path", "part_idx").collect()
    assert [(r.part_idx, r.page, r.text) for r in rows[:2]] == [(0, None, "k: 1\nv: x"), (1, None, "k: 2\nv: y")]
    assert [r.part_idx for r in rows[2:]] == list(range(500)) and rows[301].text == "k: 299\nv: z"
    assert X._csv(b"k,v\n1,x\n2,y\n") == [(None, "k: 1\nv: x"), (None, "k: 2\nv: y")]


def test_large_file_is_numbered_over_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("k\n" + "".join(f"row{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.part_idx: r.text for r in X.csv_rows_to_parts(spark, str(tmp_path), multiline=False).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"k: row{i}" for i in range(3000)}


def test_names_with_marks_are_kept(spark, tmp_path):
    for name in ("report#1.txt", "what?.txt", "plain.txt"):
        (tmp_path / name).write_text("x")
    rows = scan_corpus(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"), "file_type").collect()
    assert {(r.n, r.file_type) for r in rows} == {("report#1.txt", "txt"), ("what?.txt", "txt"), ("plain.txt", "txt")}


def test_metadata_that_is_no_object(spark):
    df = spark.createDataFrame([(1, "[1, 2]"), (2, '{"a": 1, "b": [2]}'), (3, "x"), (4, None), (5, '"s"')], "id int, j string")
    assert [tuple(r) for r in metadata_scalars(df, "id", "j").collect()] == [(2, "a", "1")]


def test_malformed_keyword_file(tmp_path):
    (tmp_path / "k.yaml").write_text("a: [1, 2\nb: }")
    pytest.importorskip("yaml")
    assert load_keywords(str(tmp_path / "k.yaml")) == {"GENERAL": []}


def test_malformed_json_keyword_file(tmp_path):
    (tmp_path / "k.json").write_text("{")
    assert load_keywords(str(tmp_path / "k.json")) == {"GENERAL": []}


def test_no_checkpoint_folder_is_an_error():
    from vellum.session import checkpoint_dir

    class Context:
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_csv_folder_with_a_header_per_file(spark, tmp_path):
    """Files of other columns, quoted line breaks, short and long rows, a byte order mark, files without rows."""
    (tmp_path / "a.csv").write_text("name,age\nann,3\n\nbob\n")
    (tmp_path / "b.csv").write_text("city,zip,land\nulm,89073,de,more\n")
    (tmp_path / "c.csv").write_text('note,k\n"two\nlines, ""quoted""",1\n')
    (tmp_path / "d.csv").write_bytes(b"\xef\xbb\xbfx\r\n1\r\n")
    (tmp_path / "e.csv").write_text("only,header\n")
    (tmp_path / "f.csv").write_text("")
    want = {("a.csv", 0): "name: ann\nage: 3", ("a.csv", 1): "name: bob\nage: ", ("b.csv", 0): "city: ulm\nzip: 89073\nland: de",
            ("c.csv", 0): 'note: two\nlines, "quoted"\nk: 1', ("d.csv", 0): "x: 1"}
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert {(name(r), r.part_idx): r.text for r in X.csv_rows_to_parts(spark, str(tmp_path)).collect()} == want
    lines = {(name(r), r.part_idx): r.text for r in X.csv_rows_to_parts(spark, str(tmp_path), multiline=False).collect()}
    assert {k: v for k, v in lines.items() if k[0] != "c.csv"} == {k: v for k, v in want.items() if k[0] != "c.csv"}
