import zlib

from scriptorium.llm.tables import labelled, remainder


def test_labels_are_bounded_and_clean(table, rows):
    marks = table("doc_id long, toxic int", (1, 0), (1, 1), (2, 0), (3, None), (None, 1), (4, 7))
    assert rows(labelled(marks, "toxic", 10)) == [(1, 1), (2, 0)]
    assert labelled(marks, "toxic", 1).count() == 1


def test_remainder_is_that_of_the_id_as_text(table):
    ids = table("doc_id long", *((i,) for i in (0, 5, 123456789, -3)))
    for r in ids.select("doc_id", remainder(7).alias("r")).collect():
        assert r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 7
