"""Lines that are new in one version of a file compared with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.text import split_lines


def line_hashes(text: Column) -> Column:
    return F.transform(split_lines(text), lambda line: F.xxhash64(line))


def added_lines(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``(<names>, line_no)`` of the lines of ``_has`` that ``_had`` lacks, both arrays of line hashes; no ``_had`` is an empty one."""
    old = F.transform(F.coalesce("_had", F.array()), lambda h: F.struct(F.lit(0).alias("_new"), F.lit(0).alias("line_no"), h.alias("_line")))
    now = F.transform(
        F.coalesce("_has", F.array()), lambda h, i: F.struct(F.lit(1).alias("_new"), (i + 1).alias("line_no"), h.alias("_line"))
    )
    lines = pairs.select(*names, F.inline(F.concat(old, now)))
    # equal lines of a file meet, base lines first: a new one is left over if it comes after twice as many as the base has
    ordered = Window.partitionBy(*names, "_line").orderBy("_new", "line_no")
    seen = F.sum(1 - F.col("_new")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = lines.withColumn("_nth", F.row_number().over(ordered)).withColumn("_seen", seen)
    return counted.filter((F.col("_new") == 1) & (F.col("_nth") > 2 * F.col("_seen"))).select(*names, "line_no")


def with_text(new: DataFrame, added: DataFrame, names: list[str]) -> DataFrame:
    """``(<names>, line_no, line)``: the text of lines given by their numbers, from ``new(<names>, text)``."""
    wanted = added.groupBy(*names).agg(F.sort_array(F.collect_list("line_no")).alias("_numbers"))
    found = new.select(*names, "text").join(wanted, names)
    texts = found.select(*names, split_lines(F.col("text")).alias("_lines"), "_numbers")
    one = texts.select(*names, "_lines", F.explode("_numbers").alias("line_no"))
    return one.select(*names, "line_no", F.element_at("_lines", F.col("line_no")).alias("line"))


def delta_lines(base: DataFrame, new: DataFrame, *, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Lines of ``new`` that ``base`` does not have, with their line number in ``new``.

    Both inputs have ``keys`` and a ``text`` column, one row per file; a file
    without a base version is new as a whole.  Counts are compared: of a line that
    occurs more often than in the base, the last occurrences are new; a line that
    merely moved is not.

    Each version is read once as 64-bit line hashes, which meet by ``keys``; that
    partitioning serves the comparison of lines as well.  Files whose hashes are equal
    go no further.  ``new`` is read a second time for the text of files with new lines.
    """
    names = list(keys)
    had = base.select(*names, line_hashes(F.col("text")).alias("_had"))
    has = new.select(*names, line_hashes(F.col("text")).alias("_has"))
    changed = has.join(had, names, "left").filter(~F.col("_has").eqNullSafe(F.col("_had")))
    return with_text(new, added_lines(changed, names), names)
