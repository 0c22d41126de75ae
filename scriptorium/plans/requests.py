"""Batches of requests from access check to history entry."""

from pyspark.sql import functions as F

from scriptorium.functions.audit import content_action, replace_action, style_action
from scriptorium.operators.catalog import OK, resolved_requests
from scriptorium.operators.edits import apply_block_edits, apply_paragraph_edits
from scriptorium.operators.images import image_counts, replace_images
from scriptorium.operators.replace import (
    BODY_AND_TABLES,
    matches_by_rule,
    replace_blocks_by_rule,
    replace_by_rule,
)
from scriptorium.operators.style import apply_run_style, stamp_pages, stamp_sections
from scriptorium.session import unsorted


def _of_type(rows, resolved, file_type):
    """Rows of documents of one type that an accepted request concerns."""
    concerned = resolved.where((F.col("status") == OK) & (F.col("file_type") == file_type))
    return rows.join(unsorted(concerned.select("doc_id").distinct()), "doc_id", "left_semi")


def find_replace_requests(requests, accounts, catalog, paragraphs, blocks):
    """Outcome of ``requests(request_id, doc_id, user_id, find_text, replace_text,
    case_sensitive)``: status, matches and history entry of each.

    Accepted requests of a document run in order of ``request_id``, each on the result of those
    before. Body and table paragraphs of docx and blocks of pdf documents are searched, each by
    the profile of its format. Without matches there is no history entry.
    """
    resolved = resolved_requests(requests, accounts, catalog)
    rules = resolved.where(F.col("status") == OK).withColumn("seq", F.col("request_id"))
    searched = paragraphs.where(F.col("scope").isin(BODY_AND_TABLES))
    totals = matches_by_rule(
        replace_by_rule(searched, rules.where("file_type = 'docx'")),
        replace_blocks_by_rule(blocks, rules.where("file_type = 'pdf'")),
    ).select(F.col("seq").alias("request_id"), "matches")
    entry = replace_action(F.col("find_text"), F.col("replace_text"), F.col("matches"))
    return (
        resolved.join(totals, "request_id", "left")
        .withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
        .withColumn("action", F.when(F.col("matches") > 0, entry).otherwise(""))
        .select(*requests.columns, "status", "matches", "action")
    )


def content_requests(requests, items, accounts, catalog, paragraphs, blocks, pages):
    """Saves of content: ``(outcomes, paragraphs, blocks)``.

    ``requests(request_id, doc_id, user_id)`` are saves, ``items(request_id, item_no, idx,
    page_num, block_no, text)`` what they submit. Items of accepted saves that the format of
    their document can take are applied, the last per address wins: body paragraphs of docx,
    blocks on existing pages of pdf documents. An outcome has the status and, if accepted, the
    history entry with the number of all submitted items.
    """
    resolved = resolved_requests(requests, accounts, catalog)
    accepted = resolved.where(F.col("status") == OK)
    edits = items.join(accepted.select("request_id", "doc_id", "file_type"), "request_id").select(
        "doc_id", "file_type", "idx", "page_num", "block_no", "text",
        F.struct("request_id", "item_no").alias("seq"),
    )
    on_pages = edits.where("file_type = 'pdf'").join(
        pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi"
    )
    counts = items.groupBy("request_id").agg(F.count("*").alias("n_items"))
    n_items = F.coalesce("n_items", F.lit(0)).cast("long")
    outcomes = resolved.join(counts, "request_id", "left").select(
        *requests.columns, "status", n_items.alias("n_items"),
        F.when(F.col("status") == OK, content_action(n_items)).otherwise("").alias("action"),
    )
    return (
        outcomes,
        apply_paragraph_edits(
            _of_type(paragraphs, resolved, "docx"), edits.where("file_type = 'docx'")
        ),
        apply_block_edits(_of_type(blocks, resolved, "pdf"), on_pages),
    )


def style_requests(requests, accounts, catalog, contents):
    """Style changes of ``requests(request_id, doc_id, user_id, font_name, font_size,
    header_text, footer_text, image_index, image)``, in order of ``request_id``.

    ``contents`` maps ``runs``, ``section_list``, ``sections``, ``pages`` and ``images`` to
    their tables. Returns outcomes and the changed tables. An accepted request logs what it
    asked for, and the document's pictures are counted again: by occurrence in docx, by stored
    image in pdf documents. Pictures change only where a request has an index and an image.
    """
    resolved = resolved_requests(requests, accounts, catalog)
    accepted = resolved.where(F.col("status") == OK).withColumn("seq", F.col("request_id"))
    docx, pdf = (accepted.where(F.col("file_type") == kind) for kind in ("docx", "pdf"))
    own = {kind: {n: _of_type(t, resolved, kind) for n, t in contents.items()} for kind in ("docx", "pdf")}

    def pictures(patches, kind, by_occurrence):
        asked = patches.select("doc_id", "seq", F.col("image_index").alias("target_index"), "image")
        return replace_images(own[kind]["images"], asked, by_occurrence)

    by_type = F.when(F.col("file_type") == "docx", F.col("n_pictures")).otherwise(F.col("n_distinct"))
    fields = (F.col(c) for c in ("font_name", "font_size", "header_text", "footer_text", "image_index"))
    ran = F.col("status") == OK
    outcomes = resolved.join(image_counts(contents["images"]), "doc_id", "left").select(
        *requests.columns, "status", F.when(ran, style_action(*fields)).otherwise("").alias("action"),
        F.when(ran, F.coalesce(by_type, F.lit(0)).cast("long")).alias("images_count"),
    )
    changed = {
        "runs": apply_run_style(own["docx"]["runs"], docx),
        "sections": stamp_sections(own["docx"]["section_list"], own["docx"]["sections"], docx),
        "stamps": stamp_pages(own["pdf"]["pages"], pdf),
        "images": pictures(docx, "docx", True).unionByName(pictures(pdf, "pdf", False)),
    }
    return outcomes, changed
