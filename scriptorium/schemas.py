"""Schemas of the tables that callers hand in: for readers and for streams."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(**columns):
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


HISTORY_ENTRY = _table(date=DateType(), action=StringType())

UPLOADS = _table(
    doc_id=LongType(),
    seq=LongType(),
    name=StringType(),
    size_bytes=LongType(),
    owner_id=StringType(),
    upload_date=DateType(),
)
CATALOG = _table(
    doc_id=LongType(),
    name=StringType(),
    file_type=StringType(),
    storage_path=StringType(),
    owner_id=StringType(),
    upload_date=DateType(),
    images_count=LongType(),
    edit_history=ArrayType(HISTORY_ENTRY),
)
HISTORY = _table(doc_id=LongType(), seq=LongType(), date=DateType(), action=StringType())
PARAGRAPHS = _table(doc_id=LongType(), idx=LongType(), text=StringType(), scope=StringType())
BLOCKS = _table(
    doc_id=LongType(),
    page_num=LongType(),
    block_no=LongType(),
    block_type=LongType(),
    text=StringType(),
)
RUNS = _table(
    doc_id=LongType(),
    idx=LongType(),
    scope=StringType(),
    run_no=LongType(),
    text=StringType(),
    font_name=StringType(),
    font_size=DoubleType(),
)
SECTIONS = _table(
    doc_id=LongType(),
    section_no=LongType(),
    part=StringType(),
    para_no=LongType(),
    text=StringType(),
)
IMAGES = _table(doc_id=LongType(), page_num=LongType(), pos=LongType(), part_id=LongType())
EDITS = _table(
    doc_id=LongType(),
    seq=LongType(),
    idx=LongType(),
    page_num=LongType(),
    block_no=LongType(),
    bbox=ArrayType(DoubleType()),
    text=StringType(),
)
STYLE_PATCHES = _table(
    doc_id=LongType(),
    seq=LongType(),
    font_name=StringType(),
    font_size=DoubleType(),
    header_text=StringType(),
    footer_text=StringType(),
    image_index=LongType(),
)
RULES = _table(
    doc_id=LongType(),
    seq=LongType(),
    find_text=StringType(),
    replace_text=StringType(),
    case_sensitive=BooleanType(),
)
