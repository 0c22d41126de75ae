"""Content edits addressed by a region of a page: which blocks a rectangle meets.

Rectangles are ``bbox`` arrays (x0, y0, x1, y1). They meet in an equi-join on the cells of a grid,
never as all pairs of a page. A rectangle's own level is the coarsest grid it needs: there it
touches four cells at most. It shows itself in its cells of that level and of all coarser ones, and two
rectangles are compared where one is at its own level, so a pair of very different sizes meets
in few cells too. Pages with very many rectangles are cut by cell.
"""

from pyspark.sql import functions as F

from scriptorium.operators.edits import BLOCK

CELL = 64.0
LEVELS = 8  # the last level has one cell: rectangles of any size meet there
SIDES = ("x0", "y0", "x1", "y1")


def with_sides(rows):
    """Rows whose ``bbox`` is a rectangle, with its sides in rising order.

    Null, too short, empty and non-finite regions are none.
    """
    box = F.col("bbox")
    numbers = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = [F.get(box, F.lit(i)).cast("double") for i in (0, 2)]
    y = [F.get(box, F.lit(i)).cast("double") for i in (1, 3)]
    sided = rows.where((F.size(box) == 4) & numbers).select(
        "*", F.least(*x).alias("x0"), F.least(*y).alias("y0"),
        F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"),
    )
    return sided.where("x0 < x1 AND y0 < y1")


def _in_cells(rows, cell, levels):
    """One row per cell of each level from a rectangle's own on; ``_own`` marks its own level."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = F.least(F.greatest(F.ceil(F.log2(size / cell)), F.lit(0)), F.lit(levels - 1)).cast("int")
    leveled = rows.withColumn("_least", own).withColumn(
        "_level", F.explode(F.sequence(F.col("_least"), F.lit(levels - 1)))
    )
    step = F.pow(F.lit(2.0), F.col("_level")) * cell
    top = F.col("_level") == levels - 1

    def cells(low, high):
        # a top cell has no sides, so coordinates of any size have one
        first, last = (
            F.when(top, F.lit(0)).otherwise(F.floor(F.col(c) / step)).cast("long") for c in (low, high)
        )
        return F.sequence(first, last)

    placed = leveled.withColumn("_x", F.explode(cells("x0", "x1")))
    placed = placed.withColumn("_y", F.explode(cells("y0", "y1")))
    return placed.withColumn("_own", F.col("_level") == F.col("_least")).drop("_least")


def overlaps(blocks, edits, cell=CELL, levels=LEVELS):
    """``(doc_id, page_num, block_no, seq, text)``: edits whose region shares area with a block's.

    A pair may come several times. Only blocks of pages that are edited go on the grid.
    """
    touched = edits.select("doc_id", "page_num").distinct()
    own = blocks.select(*BLOCK, "bbox").join(touched, ["doc_id", "page_num"], "left_semi")
    block = _in_cells(with_sides(own), cell, levels).drop("bbox")
    wanted = edits.where("text IS NOT NULL").select("doc_id", "page_num", "seq", "text", "bbox")
    edit = _in_cells(with_sides(wanted), cell, levels).drop("bbox")
    edit = edit.withColumnsRenamed({c: f"e_{c}" for c in (*SIDES, "_own")})
    met = block.join(edit, ["doc_id", "page_num", "_level", "_x", "_y"]).where(
        "(_own OR e__own) AND x0 < e_x1 AND e_x0 < x1 AND y0 < e_y1 AND e_y0 < y1"
    )
    return met.select(*BLOCK, "seq", "text")


def apply_region_edits(blocks, edits, cell=CELL, levels=LEVELS):
    """Blocks ``(doc_id, page_num, block_no, bbox, text)`` after edits ``(doc_id, page_num, seq, bbox, text)``.

    Every block shows the last edit whose region meets its own; adds ``new_text, changed``. Null
    texts are no edits and empty texts blank what they meet. A block without region stays.
    """
    latest = overlaps(blocks, edits, cell, levels).groupBy(*BLOCK).agg(
        F.max_by("text", "seq").alias("new_text")
    )
    edited = blocks.join(latest, BLOCK, "left")
    return edited.withColumn(
        "changed", F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("text"))
    ).withColumn("new_text", F.coalesce("new_text", "text"))
