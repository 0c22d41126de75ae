"""Upload gate, catalog, history, style and images."""

import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.audit import style_action
from scriptorium.operators import catalog as cat
from scriptorium.operators import history as hist
from scriptorium.operators import images as img
from scriptorium.operators import style
from scriptorium.schemas import HISTORY, IMAGES, SECTIONS, STYLE_PATCHES, UPLOADS
from scriptorium.sources import uploads

DAY = datetime.date(2024, 1, 2)
LIMIT = 10 * 1024 * 1024


def upload(doc_id, name, size=1, seq=0):
    return doc_id, seq, name, size, "me", DAY


@pytest.mark.parametrize(
    "name, size, ext, reason",
    [
        ("a.pdf", LIMIT, ".pdf", ""), ("a.pdf", LIMIT + 1, ".pdf", "file_size"),
        ("A.DOCX", 1, ".docx", ""), (".pdf", 1, "", "file_type"), ("pdf", 1, "", "file_type"),
        ("a.", 1, ".", "file_type"), ("a.txt", LIMIT + 1, ".txt", "file_type"),
        ("a..pdf", 0, ".pdf", ""), (None, 1, "", "file_type"),
    ],
)
def test_upload_gate(table, name, size, ext, reason):
    row = uploads.upload_gate(table(UPLOADS, upload(1, name, size))).first()
    assert (row.ext, row.reject_reason, row.accepted) == (ext, reason, reason == "")


def test_registered_rows(table):
    files = table(UPLOADS, upload(1, "a.DOCX"), upload(2, "b.pdf"), upload(3, "c.pdf"), upload(4, "d.txt"))
    images = table(IMAGES, *((d, 0, pos, part) for d in (1, 2) for pos, part in enumerate([7, 7, 8])))
    found = {r.doc_id: r for r in cat.register_documents(files, images).collect()}
    assert {d: (r.file_type, r.images_count) for d, r in found.items()} == {
        1: ("docx", 3), 2: ("pdf", 2), 3: ("pdf", 0)
    }
    assert [tuple(e) for e in found[1].edit_history] == [(DAY, "Uploaded document")]
    assert found[1].storage_path.endswith(".DOCX") and len(found[1].storage_path) == 64 + 5
    assert found[2].storage_path != found[3].storage_path


def test_request_outcomes(table, rows):
    requests = table(
        "request_id long, doc_id long, user_id string",
        (1, 1, "a"), (2, 1, "b"), (3, 1, "x"), (4, 9, "a"), (5, 2, "a"), (6, 3, "a"), (7, 1, None),
    )
    accounts = table("user_id string", ("a",), ("b",))
    catalog = table(
        "doc_id long, owner_id string, file_type string",
        (1, "a", "pdf"), (2, "a", "txt"), (3, "a", None),
    )
    found = cat.resolve_requests(requests, accounts, catalog)
    assert dict(rows(found, "request_id", "status")) == {
        1: 200, 2: 404, 3: 401, 4: 404, 5: 400, 6: 400, 7: 401
    }


def test_new_accounts_are_exact_and_first(table, rows):
    signups = table(
        "seq long, email string, name string",
        (3, "a@x", "late"), (1, "a@x", "first"), (2, "A@x", "other"), (4, "k@x", "known"),
    )
    found = cat.new_accounts(signups, table("email string", ("k@x",)))
    assert rows(found, "email", "seq", "name") == [("A@x", 2, "other"), ("a@x", 1, "first")]


def test_newest_first(table):
    found = cat.documents_newest_first(table("doc_id long, seq long", (1, 5), (2, 9), (3, 7))).collect()
    assert [(r.doc_id, r.position) for r in found] == [(2, 0), (3, 1), (1, 2)]


@pytest.mark.parametrize(
    "request_fields, expected",
    [
        ((None, 12.0, "H", None, None), "font=None, size=12.0, header=True, footer=False, img=False"),
        (("", 0.0, "", "", 0), "font=, size=0.0, header=True, footer=True, img=True"),
        (("Arial", None, None, "F", 3), "font=Arial, size=None, header=False, footer=True, img=True"),
        (("A%s", 10.5, None, None, None), "font=A%s, size=10.5, header=False, footer=False, img=False"),
    ],
)
def test_style_history(table, request_fields, expected):
    patch = table(STYLE_PATCHES, (1, 1, *request_fields))
    columns = [F.col(c) for c in STYLE_PATCHES.names[2:]]
    assert patch.select(style_action(*columns)).first()[0] == "Updated styling: " + expected


def test_history_rules(table, rows):
    totals = table("doc_id long, matches long", (1, 2), (2, 0))
    counts = table("doc_id long, n_submitted long", (2, 3))
    log = hist.history_append(
        table(HISTORY, (1, 0, DAY, "Uploaded document")),
        hist.replace_entries(totals, "a%d", "b'", F.lit(2).cast("long"), F.lit(DAY)),
        hist.content_entries(counts, F.lit(1).cast("long"), F.lit(DAY)),
    )
    assert log.schema == HISTORY
    assert rows(hist.history_timeline(log), "doc_id", "entry_no", "date", "action") == [
        (1, 0, DAY, "Uploaded document"),
        (1, 1, DAY, "Find & Replace: 'a%d' -> 'b'' (2 matches)"),
        (2, 0, DAY, "Edited text content (3 block(s))"),
    ]


def test_unset_fonts_keep_the_old_ones(table, rows):
    runs = table(
        "doc_id long, scope string, run_no long, font_name string, font_size double",
        (1, "body", 0, "Arial", 9.0), (1, "header", 1, "Arial", 9.0), (1, "table", 2, None, None),
        (2, "body", 0, "Arial", 9.0), (3, "body", 0, "Arial", 9.0),
    )
    patches = table(
        STYLE_PATCHES, (1, 1, "Courier", 0.0, None, None, None), (1, 2, "", 12.0, None, None, None),
        (2, 3, "", 0.0, None, None, None),
    )
    styled = style.apply_run_style(runs, patches)
    assert rows(styled, "doc_id", "run_no", "font_name", "font_size") == [
        (1, 0, "Courier", 12.0), (1, 1, "Arial", 9.0), (1, 2, "Courier", 12.0),
        (2, 0, "Arial", 9.0), (3, 0, "Arial", 9.0),
    ]


@pytest.mark.parametrize(
    "name, size, expected",
    [
        ("Times New Roman", 12.0, ("tiro", 12.0)), ("COURIER new", 0.0, ("cour", 10.0)),
        ("Calibri", None, ("helv", 10.0)), (None, 8.5, ("helv", 8.5)), ("", None, ("helv", 10.0)),
        ("courier times", 1.0, ("tiro", 1.0)),
    ],
)
def test_page_fonts(table, name, size, expected):
    row = style.page_fonts(table(STYLE_PATCHES, (1, 1, name, size, None, None, None))).first()
    assert (row.page_font, row.page_font_size) == expected


def test_stamping_sections(table, rows):
    sections = table(
        SECTIONS, (1, 0, "header", 0, "a"), (1, 0, "header", 1, "b"), (1, 0, "footer", 0, "f"),
        (2, 0, "header", 0, "keep"),
    )
    section_list = table("doc_id long, section_no long", (1, 0), (1, 1), (2, 0))
    patches = table(STYLE_PATCHES, (1, 1, None, None, "", None, None), (1, 2, None, None, None, None, None))
    stamped = style.stamp_sections(section_list, sections, patches)
    assert rows(stamped, "doc_id", "section_no", "part", "para_no", "text") == [
        (1, 0, "footer", 0, "f"), (1, 0, "header", 0, ""), (1, 0, "header", 1, ""),
        (1, 1, "header", 0, ""), (2, 0, "header", 0, "keep"),
    ]


def test_page_stamp_takes_the_font_of_its_own_patch(table, rows):
    pages = table("doc_id long, page_num long", (1, 0), (1, 1), (2, 0))
    patches = table(
        STYLE_PATCHES, (1, 1, "Times", 12.0, "old", "foot", None), (1, 2, None, None, "new", None, None)
    )
    assert rows(style.stamp_pages(pages, patches)) == [
        (1, 0, "footer", "foot", "tiro", 12.0), (1, 0, "header", "new", "helv", 10.0),
        (1, 1, "footer", "foot", "tiro", 12.0), (1, 1, "header", "new", "helv", 10.0),
    ]


@pytest.fixture
def shared_parts(table):
    return table(IMAGES, *((1, 0, pos, part) for pos, part in enumerate([5, 6, 5, 7])))


def test_image_numbers(shared_parts, rows):
    assert rows(img.picture_ordinals(shared_parts), "image_no", "part_id") == [
        (0, 5), (1, 6), (2, 5), (3, 7)
    ]
    assert rows(img.image_ordinals(shared_parts), "image_no", "part_id") == [(0, 5), (1, 6), (2, 7)]


@pytest.mark.parametrize(
    "by_occurrence, expected",
    [(True, ["c", "b", "c", None]), (False, ["a", "b", "a", "c"])],
)
def test_shared_parts_change_together(shared_parts, table, by_occurrence, expected):
    requests = table(
        "doc_id long, seq long, target_index long, image string",
        (1, 1, 0, "a"), (1, 2, 1, "b"), (1, 3, 2, "c"), (1, 4, -1, "x"), (1, 5, 9, "x"),
        (1, 6, 0, ""), (1, 7, 1, None),
    )
    changed = img.replace_images(shared_parts, requests, by_occurrence).collect()
    assert [r.new_image for r in sorted(changed, key=lambda r: r.pos)] == expected


def test_documents_without_pictures_count_zero(shared_parts, table, rows):
    docs = table("doc_id long", (1,), (2,))
    assert rows(img.picture_counts(docs, shared_parts)) == [(1, 4), (2, 0)]
    assert rows(img.distinct_image_counts(docs, shared_parts)) == [(1, 3), (2, 0)]
