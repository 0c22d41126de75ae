"""A batch of requests from access check to history entry."""

from scriptorium.plans.requests import find_replace_requests


def test_outcome_of_every_request(table, rows):
    requests = table(
        "request_id long, doc_id long, user_id string, find_text string, replace_text string, "
        "case_sensitive boolean",
        (1, 1, "a", "The", "x", False), (2, 2, "a", "the", "x", True), (3, 3, "a", "zzz", "x", True),
        (4, 4, "a", "the", "x", True), (5, 5, "b", "the", "x", True), (6, 6, "?", "the", "x", True),
        (7, 7, "a", " the", "x", True), (8, 1, "a", "x", "y", True), (9, 1, "b", "y", "z", True),
        (10, 2, "a", "x", None, True),
    )
    accounts = table("user_id string", ("a",), ("b",))
    catalog = table(
        "doc_id long, owner_id string, file_type string",
        (1, "a", "docx"), (2, "a", "pdf"), (3, "a", "docx"), (4, "a", "txt"), (5, "a", "docx"),
        (6, "a", "docx"), (7, "a", "pdf"),
    )
    paragraphs = table(
        "doc_id long, idx long, scope string, text string",
        *((d, 0, "body", "the The") for d in (1, 3, 5, 6)), (1, 1, "table", "the"),
        (1, 2, "header", "the"), (2, 0, "body", "the the the"),
    )
    blocks = table(
        "doc_id long, page_num long, block_no long, text string",
        (2, 0, 0, "the The"), (2, 1, 0, "the"), (7, 0, 0, "in the end"),
    )
    found = find_replace_requests(requests, accounts, catalog, paragraphs, blocks)
    assert sorted(rows(found, "request_id", "status", "matches", "action")) == [
        (1, 200, 3, "Find & Replace: 'The' -> 'x' (3 matches)"),
        (2, 200, 2, "Find & Replace: 'the' -> 'x' (2 matches)"),
        (3, 200, 0, ""), (4, 400, 0, ""), (5, 404, 0, ""), (6, 401, 0, ""), (7, 200, 0, ""),
        # the second request of a document works on what the first left; the third is not theirs
        (8, 200, 3, "Find & Replace: 'x' -> 'y' (3 matches)"), (9, 404, 0, ""), (10, 200, 0, ""),
    ]
