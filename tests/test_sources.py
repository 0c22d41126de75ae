"""Files in and out: word files, text files, snapshots, exports."""

import io
import weakref
import zipfile
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from scriptorium.operators.images import picture_counts
from scriptorium.plans import fixtures as fx
from scriptorium.plans.packing import pack_docx
from scriptorium.sources import docx, html, named_files, sinks, text_files

PICTURE = (
    '<w:drawing><wp:inline xmlns:wp="{wp}"><a:blip xmlns:a="{a}" xmlns:r="{r}" r:embed="{rel}"/>'
    "</wp:inline></w:drawing>"
)
RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Target="media/image1.png"/><Relationship Id="r2" Target="header1.xml"/>'
    "</Relationships>"
)


def picture(rel):
    spaces = {k: getattr(docx, k.upper()).strip("{}") for k in ("wp", "a", "r")}
    return "<w:r>" + PICTURE.format(rel=rel, **spaces) + "</w:r>"


@pytest.fixture(scope="module")
def word_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("word")
    r = docx.R.strip("{}")
    body = (
        '<w:p><w:r><w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="21"/></w:rPr><w:t>Dra</w:t></w:r>'
        "<w:r><w:t>ft</w:t><w:tab/><w:t>v2</w:t><w:br/></w:r>"
        "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:p/>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        f"<w:p>{picture('r1')}{picture('r1')}</w:p>"
        f'<w:sectPr><w:headerReference xmlns:r="{r}" w:type="default" r:id="r2"/></w:sectPr>'
    )
    w = docx.W.strip("{}")
    header = f'<w:hdr xmlns:w="{w}"><w:p><w:r><w:t>top</w:t></w:r></w:p><w:p/></w:hdr>'
    extra = {"word/_rels/document.xml.rels": RELS, "word/header1.xml": header}
    (folder / "good.docx").write_bytes(pack_docx(body, extra))
    (folder / "broken.docx").write_bytes(pack_docx(body)[:50])
    (folder / "notes.txt").write_text("not a word file")
    return folder


@pytest.fixture(scope="module")
def elements(spark, word_folder):
    return docx.docx_binary_scan(spark, str(word_folder)).cache()


def test_word_paragraphs(elements, rows):
    assert rows(docx.paragraphs_of(elements), "scope", "idx", "text") == [
        ("body", 0, "Draft\tv2\nlink"), ("body", 1, ""), ("body", 2, ""), ("table", 0, "cell")
    ]


def test_word_runs(elements, rows):
    runs = docx.runs_of(elements).where("text <> ''")
    assert rows(runs, "scope", "idx", "run_no", "text", "font_name", "font_size") == [
        ("body", 0, 0, "Dra", "Arial", 10.5), ("body", 0, 1, "ft\tv2\n", None, None),
        ("table", 0, 0, "cell", None, None),
    ]


def test_word_sections_and_pictures(elements, rows):
    assert rows(docx.section_list_of(elements), "section_no") == [(0,)]
    assert rows(docx.sections_of(elements), "section_no", "part", "para_no", "text") == [
        (0, "header", 0, "top"), (0, "header", 1, "")
    ]
    pictures = docx.pictures_of(elements).withColumnRenamed("path", "doc_id")
    assert rows(pictures, "pos", "part_id") == [(0, "media/image1.png"), (1, "media/image1.png")]
    assert rows(picture_counts(pictures.select("doc_id").distinct(), pictures), "images_count") == [(2,)]


def test_unreadable_word_file_is_reported(elements, rows):
    errors = docx.errors_of(elements).collect()
    assert [r.path.rsplit("/", 1)[1] for r in errors] == ["broken.docx"]
    assert "BadZipFile" in errors[0].error


def test_word_file_over_the_limit_is_not_read(spark, word_folder):
    found = docx.docx_elements(docx.docx_files(spark, str(word_folder)), max_bytes=10).collect()
    assert sorted((r.kind, r.text) for r in found) == [("error", "file_size")] * 2


def test_text_files(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\r\ntwo\n")
    (tmp_path / "b.txt").write_bytes(b"no end")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    (tmp_path / "c.pdf").write_bytes(b"other")
    found = text_files.text_file_scan(spark, str(tmp_path), max_bytes=50)
    assert rows(found, "idx", "text") == [
        (0, "no end"), (0, "one"), (1, ""), (2, "two"), (None, None),
    ]
    assert [r.path[-7:] for r in found.where("idx is null").collect()] == ["big.txt"]
    assert text_files.text_file_scan(spark, str(tmp_path)).where("text like 'xxx%'").count() == 1


def test_snapshots_are_versions(spark, tmp_path, table):
    schema = "doc_id long, text string, file_type string"
    first, second = table(schema, (1, "a", "pdf")), table(schema, (1, "b", "docx"))
    sinks.snapshot_write(first, str(tmp_path), 1)
    sinks.snapshot_write(second, str(tmp_path), 2)
    with pytest.raises(AnalysisException):
        sinks.snapshot_write(first, str(tmp_path), 1)
    for version, state in ((1, first), (2, second)):
        found = sinks.read_snapshot(spark, str(tmp_path), version, first.schema)
        assert found.select(*first.columns).collect() == state.collect()


def test_export_names_the_document_of_every_line(spark, tmp_path, table, rows):
    docs = table("doc_id long, text string", (1, "a\tb\n\nc\r"), (2, None), (3, "x"))
    catalog = table("doc_id long, file_type string", (1, "pdf"), (2, "docx"))
    sinks.export_text(docs, catalog, str(tmp_path / "out"))
    found = sinks.read_export(spark, str(tmp_path / "out"))
    assert rows(found, "doc_id", "file_type", "line_no", "line") == [
        (1, "pdf", 0, "a\tb"), (1, "pdf", 1, ""), (1, "pdf", 2, "c\r"), (2, "docx", 0, ""), (3, "other", 0, "x"),
    ]


def test_export_of_whole_documents(spark, sf_dir, tmp_path):
    docs = fx.documents(spark, sf_dir)
    sinks.export_text(docs, docs.selectExpr("doc_id", "'pdf' AS file_type"), str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "file_type=pdf").glob("*.txt"))
    written = "".join(f.read_text(encoding="utf8") for f in files)
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    assert written == "".join(f"{d}\t{i}\t{t}\n" for d, text in texts for i, t in enumerate(text.split("\n")))


def test_damage_of_one_part_leaves_the_rest(spark, table, word_folder, rows):
    body = (
        '<w:p><w:r><w:rPr><w:sz/></w:rPr><w:t>kept</w:t></w:r></w:p>' + f"<w:p>{picture('r1')}</w:p>"
        f'<w:sectPr><w:headerReference xmlns:r="{docx.R.strip("{}")}" w:type="default" r:id="gone"/></w:sectPr>'
    )
    content = pack_docx(body, {"word/_rels/document.xml.rels": RELS})
    files = table("path string, length long, content binary", ("/x/s1.docx", len(content), bytearray(content)))
    found = docx.docx_elements(files)
    assert rows(found.where("kind = 'paragraph'"), "text") == [("",), ("kept",)]
    assert found.where("kind = 'picture'").count() == 1
    assert [r.text for r in found.where("kind = 'error'").collect()] == ["KeyError: 'gone'"]
    catalog = table("doc_id long, storage_path string", (7, "s1.docx"), (8, "s2.docx"))
    named = docx.with_doc_id(docx.paragraphs_of(found), catalog)
    assert rows(named, "doc_id", "scope", "idx", "text") == [(7, "body", 0, "kept"), (7, "body", 1, "")]


def test_parts_of_any_size_are_read_as_streams(spark, table):
    many = 30_000
    row = "<w:tr><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc></w:tr>"
    body = "<w:p><w:r><w:t>x</w:t></w:r></w:p>" * many
    body += "<w:tbl>" + "".join(row.format(i) for i in range(many)) + "</w:tbl>"
    content = pack_docx(body)
    kinds = Counter((r["kind"], r.get("scope")) for r in docx._elements(content))
    assert kinds == {(k, s): many for k in ("paragraph", "run") for s in ("body", "table")}
    assert max(r["idx"] for r in docx._elements(content)) == many - 1
    seen = []
    for own, element in docx._children(zipfile.ZipFile(io.BytesIO(content)).open("word/document.xml"),
                                       docx.BODY, (docx.TABLE,)):
        seen.append(weakref.ref(element)) if len(seen) < 5 else None
    assert all(ref() is None for ref in seen)  # nothing is kept once it was read


def test_rows_before_damage_are_kept():
    whole = pack_docx("<w:p/>" * 3)
    with zipfile.ZipFile(io.BytesIO(whole)) as archive:
        xml = archive.read("word/document.xml").decode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml.replace("</w:body>", "<broken"))
    kinds = [r["kind"] for r in docx._elements(out.getvalue())]
    assert kinds == ["paragraph"] * 3 + ["error"]


def test_named_files(spark, tmp_path, table):
    rows = table("name string, content string, key string", *((f"{i}.txt", f"text {i}", "x") for i in range(50)),
                 ("empty.txt", None, "x"))
    out = tmp_path / "out"
    named_files.write_named_files(rows.repartition(3), str(out))
    found = {f.name: f.read_text() for f in out.rglob("*.txt")}
    assert found == {**{f"{i}.txt": f"text {i}" for i in range(50)}, "empty.txt": ""}
    assert sorted(p.name[:5] for p in out.iterdir()) == ["_SUCC", "part-", "part-", "part-"]
    read = spark.read.text(str(out), wholetext=True, recursiveFileLookup=True).count()
    assert read == 50  # an empty file has no rows
    named_files.write_named_files(rows.limit(0), str(tmp_path / "none"))
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


@pytest.mark.parametrize("name", ["a/b", "_hidden", ".x", "", "same.txt"])
def test_a_failed_write_leaves_no_files(spark, tmp_path, table, name):
    rows = table("name string, content string", ("same.txt", "1"), (name, "2"))
    with pytest.raises(Exception, match="file"):
        named_files.write_named_files(rows.coalesce(1), str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.txt"))


PAGES = [
    ('<script>var t="</p>";</script><h1 class="x">A &amp; B</h1><p id=1>one<b> two </b><br>three<p>four'
     "<ul><li>i<li>j</ul>tail<table><tr><td>c</table><footer>&copy; x &middot; y</footer>",
     [("h1", "A & B"), ("p", "one two\nthree"), ("p", "four"), ("li", "i"), ("li", "j"), ("", "tail"),
      ("td", "c"), ("footer", "\u00a9 x \u00b7 y")]),
    ('<p title="a>b">x</p><!-- <p>no</p> --><style>p{}</style>y&#233;&eacute; 1 < 2',
     [("p", "x"), ("", "y\u00e9\u00e9 1 < 2")]),
    ("<pre>a\n  b<br>c</pre><div>d<p>e</div>f", [("pre", "a\n  b\nc"), ("div", "d"), ("p", "e"), ("", "f")]),
    ("<p>open<script>p = '<p>'", [("p", "open")]),
    ("<p> <b> </b>&nbsp;</p><p>x", [("p", "x")]),
    ("plain", [("", "plain")]), ("", []), (None, []),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_html_elements(page, want):
    assert list(html.blocks_of(page or "")) == want


def test_html_blocks(spark, table, rows):
    pages = table("page_id long, html string, text string", *((i, p, "clash") for i, (p, _) in enumerate(PAGES)))
    want = [(i, 0, n, *block) for i, (_, blocks) in enumerate(PAGES) for n, block in enumerate(blocks)]
    assert rows(html.html_blocks(pages)) == sorted(want, key=repr)


@pytest.mark.parametrize("piece", [1, 7, html.PIECE])
def test_references_without_a_semicolon_stay(monkeypatch, piece):
    monkeypatch.setattr(html, "PIECE", piece)
    page = "<p>a&amp;&amp</p><p>&copy 1 &notit; &#65; &#66 &#x43; &; & &nosuch;</p><p>&amp;lt; \x00 &eacute"
    want = ["a&&amp", "&copy 1 &notit; A &#66 C &; & &nosuch;", "&lt; \ufffd &eacute"]
    assert [text for _, text in html.blocks_of(page)] == want


def test_long_and_deep_pages():
    page = "<div>" * 50_000 + "<p>word &amp; word</p>" * 20_000
    assert list(html.blocks_of(page)) == [("p", "word & word")] * 20_000
    assert len("".join(t for _, t in html.blocks_of("<p>" + "long text " * 2_000_000))) == 19_999_999


@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<br>", "<b>", "&lt;", "a", " ", "</div>"])))
def test_html_pieces_change_nothing(parts):
    page = "".join(parts)
    whole = list(html.blocks_of(page))
    before, html.PIECE = html.PIECE, 1
    try:
        assert list(html.blocks_of(page)) == whole
    finally:
        html.PIECE = before


def test_small_files_share_tasks(spark, tmp_path, rows):
    """Spark alone plans 32 files to a task."""
    for i in range(700):
        (tmp_path / f"{i}.txt").write_text(f"é {i}\nb\n")
    (tmp_path / "0.docx").write_bytes(pack_docx("<w:p/>"))
    for i in range(1, 700):
        (tmp_path / f"{i}.docx").write_bytes((tmp_path / "0.docx").read_bytes())
    most = 4 * spark.sparkContext.defaultParallelism
    texts = text_files.text_file_scan(spark, str(tmp_path))
    words = docx.docx_binary_scan(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() <= most and words.rdd.getNumPartitions() <= most
    assert texts.count() == 1400 and texts.where("idx = 0 AND text LIKE 'é %'").count() == 700
    assert words.where("kind = 'paragraph'").select("path").distinct().count() == 700
