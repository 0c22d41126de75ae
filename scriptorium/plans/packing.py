"""Word files made from documents, as input for the file scan."""

import io
import sys
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import cloudpickle

from scriptorium.sources.docx import WP, A, R, W

# as for the parser: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = "name string, content binary"
ARROW_FILES = pa.schema([("name", pa.string()), ("content", pa.binary())])


def pack_docx(body_xml, extra=None):
    """Bytes of a word file with ``body_xml`` inside its body; ``extra`` maps names to parts."""
    name_space = W.strip("{}")
    document = f'<w:document xmlns:w="{name_space}"><w:body>{body_xml}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", document)
        for name, part in (extra or {}).items():
            archive.writestr(name, part)
    return out.getvalue()


FONT = '<w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="21"/></w:rPr>'


def _run(text, font=""):
    return f'<w:r>{font}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def _paragraph(text):
    return f"<w:p>{_run(text[:5], FONT)}{_run(text[5:])}</w:p>"


def _word_file(doc_id, text):
    """Lines as paragraphs of two runs, the first line in a table too, up to two pictures, a section.

    Nine documents of ten have a header of two paragraphs.
    """
    lines = text.split("\n")
    body = "".join(map(_paragraph, lines))
    body += f"<w:tbl><w:tr><w:tc><w:p>{_run(lines[0])}</w:p></w:tc></w:tr></w:tbl>"
    pictures = doc_id % 3
    rels = "".join(f'<Relationship Id="p{i}" Target="media/image{i}.png"/>' for i in range(pictures))
    if pictures:
        wp, a, r = (x.strip("{}") for x in (WP, A, R))
        body += "<w:p>" + "".join(
            f'<w:r><w:drawing><wp:inline xmlns:wp="{wp}"><a:blip xmlns:a="{a}" xmlns:r="{r}" '
            f'r:embed="p{i}"/></wp:inline></w:drawing></w:r>' for i in range(pictures)
        ) + "</w:p>"
    extra, header = {}, ""
    if doc_id % 10:
        header = f'<w:headerReference xmlns:r="{R.strip("{}")}" w:type="default" r:id="h"/>'
        rels += '<Relationship Id="h" Target="header1.xml"/>'
        extra["word/header1.xml"] = (
            f'<w:hdr xmlns:w="{W.strip("{}")}"><w:p>{_run(f"header {doc_id}")}</w:p><w:p/></w:hdr>'
        )
    body += f"<w:sectPr>{header}</w:sectPr>"
    extra["word/_rels/document.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    return pack_docx(body, extra)


def _pack(batches):
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            content = _word_file(doc_id, text or "")
            # every 50th file is cut short, so that reading it fails
            if doc_id % 50 == 49:
                content = content[: len(content) // 2]
            yield pa.RecordBatch.from_pylist(
                [{"name": f"{doc_id}.docx", "content": content}], ARROW_FILES
            )


def docx_files_of(docs):
    """``(doc_id, text)`` to names and contents of word files."""
    return docs.select("doc_id", "text").mapInArrow(_pack, FILES)
