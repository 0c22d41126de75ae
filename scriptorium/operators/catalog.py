"""Document catalog: registration, listings, routing and access."""

from pyspark.sql import functions as F

from scriptorium.functions.audit import UPLOAD_ACTION
from scriptorium.operators.images import image_counts
from scriptorium.operators.ordinals import with_ordinal
from scriptorium.sources.uploads import accepted_uploads, storage_keys

# Outcome codes of a request.
OK, UNSUPPORTED, NOT_FOUND, NO_USER = 200, 400, 404, 401


def register_documents(files, images):
    """Catalog rows of the accepted uploads, each with its one-entry history.

    Pictures are counted by occurrence in docx files, by stored image in pdf files.
    """
    counts = image_counts(images)
    by_type = F.when(F.col("file_type") == "docx", F.col("n_pictures")).otherwise(
        F.col("n_distinct")
    )
    entry = F.struct(F.col("upload_date").alias("date"), F.lit(UPLOAD_ACTION).alias("action"))
    return (
        storage_keys(accepted_uploads(files))
        .drop("images_count")
        .join(counts, "doc_id", "left")
        .select(
            "doc_id",
            "name",
            "file_type",
            "storage_path",
            "owner_id",
            "upload_date",
            F.coalesce(by_type, F.lit(0)).cast("long").alias("images_count"),
            F.array(entry).alias("edit_history"),
        )
    )


def list_owner_documents(catalog, owner_id):
    return catalog.where(F.col("owner_id") == owner_id)


def document_listing(catalog):
    """Dashboard columns; a missing image count shows as 0."""
    return catalog.select(
        F.col("doc_id").alias("id"),
        "name",
        "file_type",
        F.coalesce("images_count", F.lit(0)).cast("long").alias("images_count"),
        F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date"),
    )


def upload_dates(catalog):
    return catalog.select(
        "doc_id", F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date")
    )


def route_by_type(catalog):
    """Add ``route``: which content profile a document follows."""
    route = (
        F.when(F.col("file_type") == "docx", "paragraphs")
        .when(F.col("file_type") == "pdf", "blocks")
        .otherwise("unsupported")
    )
    return catalog.withColumn("route", route)


def documents_newest_first(catalog):
    """Add ``position``, 0 for the latest upload by ``seq``, and order by it."""
    keyed = catalog.withColumn("_newest", -F.col("seq"))
    return with_ordinal(keyed, [], "_newest", "position").drop("_newest").orderBy("position")


def known_documents(ids, catalog):
    """Rows of ``ids`` whose document is in the catalog."""
    return ids.join(catalog.select("doc_id"), "doc_id", "left_semi")


def resolved_requests(requests, accounts, catalog):
    """``resolve_requests`` with the ``file_type`` of the document, null unless it is theirs."""
    return _resolved(requests, accounts, catalog)


def resolve_requests(requests, accounts, catalog):
    """Add ``status``: no such user, no such document of theirs, unsupported type, or OK.

    A document of another owner is reported exactly like a missing one. Both lookups
    have unique keys; a user or document with very many requests is split by the
    adaptive skew join.
    """
    return _resolved(requests, accounts, catalog).drop("file_type")


def _resolved(requests, accounts, catalog):
    users = accounts.select("user_id", F.lit(True).alias("has_account"))
    owned = catalog.select(
        "doc_id", F.col("owner_id").alias("user_id"), "file_type", F.lit(True).alias("is_owner")
    )
    supported = F.coalesce(F.col("file_type").isin("docx", "pdf"), F.lit(False))
    status = (
        F.when(F.col("has_account").isNull(), NO_USER)
        .when(F.col("is_owner").isNull(), NOT_FOUND)
        .when(~supported, UNSUPPORTED)
        .otherwise(OK)
    )
    return (
        requests.join(users, "user_id", "left")
        .join(owned, ["doc_id", "user_id"], "left")
        .select(*requests.columns, status.cast("long").alias("status"), "file_type")
    )


def catalog_state(catalog, history, counts=None):
    """The catalog after a batch: ``edit_history`` from the history table, new picture counts.

    The entries of a document stand in order of ``seq``; ``counts(doc_id, images_count)`` has
    one row for each document counted again, others keep their count.
    """
    entries = history.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "date", "action"))).alias("_entries")
    )
    view = F.transform("_entries", lambda e: F.struct(e["date"].alias("date"), e["action"].alias("action")))
    state = catalog.drop("edit_history").join(entries, "doc_id", "left").withColumn(
        "edit_history", F.coalesce(view, F.array().cast("array<struct<date:date,action:string>>"))
    ).drop("_entries")
    if counts is None:
        return state
    again = counts.select("doc_id", F.col("images_count").alias("_again"))
    return state.join(again, "doc_id", "left").withColumn(
        "images_count", F.coalesce("_again", "images_count")
    ).drop("_again")


def new_accounts(signups, known_emails):
    """First sign-up per exact email that has no account yet."""
    first = signups.groupBy("email").agg(
        F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name")
    )
    return first.join(known_emails.select("email"), "email", "left_anti")
