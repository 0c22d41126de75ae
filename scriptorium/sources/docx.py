"""Word files as rows. Spark lists, splits and reads the files; a task reads one at a time as a stream."""

import io
import sys
import zipfile
from itertools import islice
from posixpath import basename, join
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scriptorium.session import by_bytes, planned_bytes

# the parser travels with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Name spaces of the file format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

BATCH_ROWS = 10_000

ELEMENTS = (
    "path string, kind string, scope string, idx long, run_no long, section_no long, "
    "para_no long, text string, font_name string, font_size double, part_id string"
)
ARROW_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
ARROW_ELEMENTS = pa.schema(
    [(name, ARROW_TYPES[kind]) for name, kind in map(str.split, ELEMENTS.split(", "))]
)
INLINE_TEXT = {f"{W}tab": "\t", f"{W}ptab": "\t", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}


def _run_text(run):
    pieces = []
    for node in run:
        if node.tag == f"{W}t":
            pieces.append(node.text or "")
        elif node.tag == f"{W}br":
            soft = node.get(f"{W}type", "textWrapping") == "textWrapping"
            pieces.append("\n" if soft else "")
        else:
            pieces.append(INLINE_TEXT.get(node.tag, ""))
    return "".join(pieces)


def _paragraph_text(paragraph):
    runs = []
    for node in paragraph:
        if node.tag == f"{W}r":
            runs.append(node)
        elif node.tag == f"{W}hyperlink":
            runs.extend(node.findall(f"{W}r"))
    return "".join(map(_run_text, runs))


def _font(run):
    name = run.find(f"{W}rPr/{W}rFonts")
    size = run.find(f"{W}rPr/{W}sz")
    points = None if size is None else size.get(f"{W}val")
    try:
        points = None if points is None else float(points) / 2
    except ValueError:  # not a number: as if not set
        points = None
    return {"font_name": None if name is None else name.get(f"{W}ascii"), "font_size": points}


def _children(stream, inside, until):
    """``(path, element)`` of each whole child of the element whose path of tags is ``inside``.

    Read as a stream: an element is gone once the next one is asked for. Elements whose path is in
    ``until`` are not built up either; their own children are given instead.
    """
    path, opened = [], []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(element.tag)
            opened.append(element)
            continue
        own = tuple(path)
        path.pop()
        opened.pop()
        if own[:-1] == inside or own[:-1] in until:
            if own not in until:
                yield own, element
            opened[-1].remove(element)


BODY = (f"{W}document", f"{W}body")
TABLE = (*BODY, f"{W}tbl")


def _targets(archive, part):
    """Relationship id to target part of ``part``."""
    rels = f"word/_rels/{basename(part)}.rels"
    if rels not in archive.namelist():
        return {}
    with archive.open(rels) as stream:
        return {r.get("Id"): r.get("Target") for r in ElementTree.parse(stream).getroot()}


def _body(archive, targets, references):
    """All rows of the body, element by element; a table is read row by row.

    Paragraphs of the body and those of table cells are counted apart. Header and footer
    ``references`` of sections are left for later.
    """
    counts = {"body": 0, "table": 0, "section": 0, "picture": 0}
    with archive.open("word/document.xml") as stream:
        for own, element in _children(stream, BODY, (TABLE,)):
            if own == (*BODY, f"{W}p"):
                yield from _paragraph("body", element, counts)
            elif own == (*TABLE, f"{W}tr"):
                for cell in element.findall(f"{W}tc"):
                    for paragraph in cell.findall(f"{W}p"):
                        yield from _paragraph("table", paragraph, counts)
            for section in element.iter(f"{W}sectPr"):
                yield {"kind": "section", "section_no": counts["section"]}
                references += (
                    (counts["section"], part, ref.get(f"{R}id"))
                    for part in ("header", "footer")
                    for ref in section.findall(f"{W}{part}Reference")
                    if ref.get(f"{W}type", "default") == "default"
                )
                counts["section"] += 1
            yield from _pictures(element, targets, counts)


def _paragraph(scope, paragraph, counts):
    """A paragraph and its runs."""
    place = {"scope": scope, "idx": counts[scope]}
    counts[scope] += 1
    yield {"kind": "paragraph", "text": _paragraph_text(paragraph), **place}
    for run_no, run in enumerate(paragraph.findall(f"{W}r")):
        yield {"kind": "run", "run_no": run_no, "text": _run_text(run), **_font(run), **place}


def _sections(archive, targets, references):
    """Paragraphs of the headers and footers that a section defines itself."""
    for section_no, part, reference in references:
        target = join("/word", targets[reference]).lstrip("/")
        with archive.open(target) as stream:
            kind = f"{W}hdr" if part == "header" else f"{W}ftr"
            paragraphs = (e for own, e in _children(stream, (kind,), ()) if own[-1] == f"{W}p")
            for para_no, paragraph in enumerate(paragraphs):
                yield {
                    "kind": "stamp", "scope": part, "section_no": section_no,
                    "para_no": para_no, "text": _paragraph_text(paragraph),
                }


def _pictures(element, targets, counts):
    """Embedded inline pictures in document order; linked and floating ones do not count."""
    inlines = (i for run in element.iter(f"{W}r") for i in run.findall(f"{W}drawing/{WP}inline"))
    blips = (blip for inline in inlines for blip in inline.iter(f"{A}blip"))
    for blip in blips:
        if blip.get(f"{R}embed") and not blip.get(f"{R}link"):
            target = targets.get(blip.get(f"{R}embed"))
            yield {"kind": "picture", "idx": counts["picture"], "part_id": target}
            counts["picture"] += 1


def _or_error(rows):
    """The rows up to the first damage, which becomes an error row of its own."""
    try:
        yield from rows
    except Exception as error:  # damage of any kind
        yield {"kind": "error", "text": f"{type(error).__name__}: {error}"}


def _parts(content):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        targets, references = {}, []

        def related():
            targets.update(_targets(archive, "word/document.xml"))
            yield from ()

        yield from _or_error(related())
        yield from _or_error(_body(archive, targets, references))
        yield from _or_error(_sections(archive, targets, references))


def _elements(content):
    """All that can be read: relations, body, headers and footers fail apart from each other."""
    return _or_error(_parts(content))


def _rows(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            place = {"path": path.as_py()}
            for row in _elements(content.as_py()):
                yield place | row


def _parse(batches):
    rows = _rows(batches)
    while block := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_pylist(block, ARROW_ELEMENTS)


def docx_elements(files, max_bytes=None):
    """Everything read from ``files(path, length, content)``, one row per element.

    Damage gives a row of kind ``error`` beside what could be read before it. Parts are unpacked and
    parsed as streams, so a part may be of any size; a paragraph or a table row is in memory at a
    time. Limits of uploads are the gate's; with ``max_bytes`` larger files give an error row only,
    and their content is not read. Files reach a task in Arrow batches, limited in bytes by the
    session's ``spark.sql.execution.arrow.maxBytesPerBatch``, and are parsed one by one.
    """
    if max_bytes is None:
        return files.select("path", "content").mapInArrow(_parse, ELEMENTS)
    parsed = files.where(F.col("length") <= max_bytes).select("path", "content")
    too_large = files.where(F.col("length") > max_bytes).select(
        "path", F.lit("error").alias("kind"), F.lit("file_size").alias("text")
    )
    return parsed.mapInArrow(_parse, ELEMENTS).unionByName(too_large, allowMissingColumns=True)


def docx_files(spark, path):
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.docx")
        .option("recursiveFileLookup", True)
        .load(path)
    )


def docx_binary_scan(spark, path):
    files = docx_files(spark, path)
    return docx_elements(by_bytes(files, planned_bytes(files)))


def with_doc_id(rows, catalog):
    """Rows of a scan with the ``doc_id`` whose ``storage_path`` names their file.

    Replaces ``path``, so that paragraphs, runs, pictures and sections fit the operators.
    """
    stored = catalog.select("doc_id", F.col("storage_path").alias("_stored"))
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return rows.join(stored, name == F.col("_stored")).drop("path", "_stored")


def paragraphs_of(elements):
    """Body and table paragraphs; the content listing shows scope ``body`` only."""
    return elements.where("kind = 'paragraph'").select("path", "scope", "idx", "text")


def runs_of(elements):
    return elements.where("kind = 'run'").select(
        "path", "scope", "idx", "run_no", "text", "font_name", "font_size"
    )


def pictures_of(elements):
    return elements.where("kind = 'picture'").select("path", F.col("idx").alias("pos"), "part_id")


def section_list_of(elements):
    return elements.where("kind = 'section'").select("path", "section_no")


def sections_of(elements):
    return elements.where("kind = 'stamp'").select(
        "path", "section_no", F.col("scope").alias("part"), "para_no", "text"
    )


def errors_of(elements):
    return elements.where("kind = 'error'").select("path", F.col("text").alias("error"))
