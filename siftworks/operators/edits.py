"""Edit logs over blobs: single-byte edits as typed in a viewer, and whole write commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions import bytes as B
from siftworks.operators.blobs import CHUNK_BYTES, blob_chunks, offset_text, row_cells, row_gutter

# Offsets are grouped in stretches of this many bytes while runs are found.
STRETCH = 1 << 16

BAD_OFFSET = "an offset is not a number"
NO_DATA = "there is no data to write"


def last_edit_wins(edit_log: DataFrame) -> DataFrame:
    """``edit_log(path, seq, offset, byte)`` to one row per (path, offset); edits without a byte are dropped."""
    valid = edit_log.filter(F.col("byte").isNotNull())
    return valid.groupBy("path", "offset").agg(F.max_by("byte", "seq").alias("byte"))


def edit_islands(edits: DataFrame) -> DataFrame:
    """Number the runs of contiguous offsets within each stretch of a path.

    A path's offsets are numbered stretch by stretch, so an often-edited path is
    shared by many tasks; runs that cross a border are joined in ``coalesce_runs``.
    """
    stretched = edits.withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    position = F.row_number().over(Window.partitionBy("path", "stretch").orderBy("offset"))
    return stretched.withColumn("island", F.col("offset") - position)


def _bytes_of(entries: Column) -> Column:
    cells = F.transform(entries, lambda e: F.lpad(F.hex(e["byte"].cast("long")), 2, "0"))
    return F.unhex(F.array_join(cells, ""))


def _join_pieces(pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p["bytes"])), ""))


def coalesce_runs(edits: DataFrame) -> DataFrame:
    """Contiguous edits as runs ``(path, start, length, bytes)``; one edit per (path, offset) is expected."""
    pieces = (
        edit_islands(edits)
        .groupBy("path", "stretch", "island")
        .agg(
            F.min("offset").alias("start"),
            F.count("*").alias("length"),
            _bytes_of(F.array_sort(F.collect_list(F.struct("offset", "byte")))).alias("bytes"),
        )
        .select("path", "start", "length", "bytes")
    )
    end = F.col("start") + F.col("length")
    at_border = (F.col("start") % STRETCH == 0) | (end % STRETCH == 0)
    # at most two pieces per stretch touch a border, so a path's window stays small
    by_start = Window.partitionBy("path").orderBy("start")
    opens = F.coalesce((F.col("start") != F.lag(end).over(by_start)).cast("int"), F.lit(1))
    joined = (
        pieces.filter(at_border)
        .withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(by_start))
        .groupBy("path", "_run")
        .agg(
            F.min("start").alias("start"),
            F.sum("length").alias("length"),
            _join_pieces(F.array_sort(F.collect_list(F.struct("start", "bytes")))).alias("bytes"),
        )
        .drop("_run")
    )
    return pieces.filter(~at_border).unionByName(joined)


def apply_runs(blobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Blobs with all their runs patched in; runs are cut at the end of the content, later ones ignored.

    The new content is put together in one pass from the stretches between runs,
    so the cost grows with the content and not with content times runs.  Runs past the end are
    dropped before a blob's runs are brought together.
    """
    ends = blobs.select("path", F.octet_length("content").alias("_end"))
    reaching = runs.join(ends, "path").filter(F.col("start") < F.col("_end"))
    per_path = reaching.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("_runs"))
    content, n = F.col("content"), B.size(F.col("content"))
    inside = F.filter("_runs", lambda r: r["start"] < n)

    def piece(run: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_inside", i - 1))
        done = F.coalesce(before["start"] + B.size(before["bytes"]), F.lit(0).cast("long"))
        kept = B.cut(content, done, run["start"] - done)
        return F.concat(F.hex(kept), F.hex(B.head(run["bytes"], n - run["start"])))

    last = F.element_at("_inside", -1)
    rest = F.hex(B.tail(content, last["start"] + B.size(last["bytes"])))
    patched = F.unhex(F.concat(F.array_join(F.transform("_inside", piece), ""), rest))
    joined = blobs.join(per_path, "path", "left").withColumn("_inside", inside)
    changed = F.coalesce(F.size("_inside") > 0, F.lit(False))
    return joined.withColumn("content", F.when(changed, patched).otherwise(content)).drop("_runs", "_inside")


def edits_preview(blobs: DataFrame, edits: DataFrame) -> DataFrame:
    """Hex rows with pending edits laid over the stored bytes.

    ``hex`` shows the edited cells and ``dirty`` their positions in the row; the
    gutter shows the stored bytes.  Edits are grouped per piece of a blob and meet it
    before it is cut into rows, so a shuffle moves pieces and not rows.
    """
    row = F.col("offset") - F.pmod("offset", F.lit(B.ROW_BYTES))
    cells = F.map_from_entries(F.collect_list(F.struct("cell", "digits")))
    per_piece = (
        edits.select("path", row.alias("row_offset"), F.pmod("offset", F.lit(B.ROW_BYTES)).cast("int").alias("cell"),
                     F.lpad(F.hex(F.col("byte").cast("long")), 2, "0").alias("digits"))
        .groupBy("path", "row_offset")
        .agg(cells.alias("_cells"))
        .groupBy("path", (F.col("row_offset") - F.pmod("row_offset", F.lit(CHUNK_BYTES))).alias("base"))
        .agg(F.map_from_entries(F.collect_list(F.struct("row_offset", "_cells"))).alias("_rows"))
    )
    pieces = blob_chunks(blobs.select("path", "content")).join(per_piece, ["path", "base"], "left")
    steps = F.sequence(F.lit(0), F.octet_length("piece") - 1, F.lit(B.ROW_BYTES))
    cut = pieces.select("path", "base", "piece", "_rows", F.explode(steps).alias("_step"))
    rows = cut.select(
        "path",
        (F.col("base") + F.col("_step")).alias("row_offset"),
        F.substring("piece", F.col("_step") + 1, F.lit(B.ROW_BYTES)).alias("row_bytes"),
        F.try_element_at("_rows", F.col("base") + F.col("_step")).alias("_cells"),
    )
    stored, row_bytes = row_cells(F.col("row_bytes")), F.col("row_bytes")
    edited = F.transform(stored, lambda cell, i: F.coalesce(F.try_element_at("_cells", i), cell))
    inside = F.filter(F.map_keys("_cells"), lambda i: i < F.octet_length(row_bytes))
    return rows.select(
        "path",
        "row_offset",
        offset_text(F.col("row_offset")).alias("offset"),
        F.when(F.col("_cells").isNull(), stored).otherwise(edited).alias("hex"),
        row_gutter(row_bytes).alias("ascii"),
        F.coalesce(F.array_sort(inside), F.array().cast("array<int>")).alias("dirty"),
    )


def payload_join(edits: DataFrame, payloads: DataFrame) -> DataFrame:
    """Fill ``data`` from the blob named by ``payload_path``, from ``payload_offset`` on; NULL where there is no such blob.

    Commands with data of their own take no part in the join.
    """
    source = payloads.select(F.col("path").alias("payload_path"), F.col("content").alias("_payload"))
    named = edits.filter(F.col("payload_path").isNotNull()).join(source, "payload_path", "left")
    filled = named.withColumn("data", B.payload(F.col("_payload"), F.col("payload_offset"))).select(*edits.columns)
    return edits.filter(F.col("payload_path").isNull()).unionByName(filled)


def edit_results(blobs: DataFrame, edits: DataFrame) -> DataFrame:
    """The content each write command gives when applied to its blob: ``(path, seq, content, error)``.

    ``edits(path, seq, mode, offset, end_offset, data, append_zero, reverse, dialect)``
    with ``mode`` overwrite or insert and offsets as typed, ``eof`` included.  A command that cannot be
    carried out has no content and an error: without data, with offsets that do not parse (the cli takes a
    single one for 0, and ``eof`` for the end), or with a result too long for one value.
    """
    gui_typed = F.col("dialect") == "gui"

    def parsed_as_typed(name: str) -> Column:
        return F.when(gui_typed, B.parse_int_auto(F.col(name), "gui")).otherwise(B.parse_int_auto(F.col(name)))

    # parsed in a projection of their own, since every form below uses them several times
    parsed = edits.select(
        "path", "seq", "data", "append_zero", "reverse",
        gui_typed.alias("_gui"),
        (F.col("mode") == "overwrite").alias("_overwrite"),
        (~gui_typed & (F.col("offset") == "eof") & F.col("end_offset").isNull()).alias("_at_end"),
        F.col("end_offset").isNotNull().alias("_ranged"),
        parsed_as_typed("offset").alias("_first"),
        parsed_as_typed("end_offset").alias("_second"),
    )
    first, second = F.col("_first"), F.col("_second")
    ranged, at_end, overwrite = F.col("_ranged"), F.col("_at_end"), F.col("_overwrite")
    unread = ((F.col("_gui") | ranged) & first.isNull()) | (ranged & second.isNull())
    refused = F.when(F.col("data").isNull(), F.lit(NO_DATA)).when(unread, F.lit(BAD_OFFSET))
    checked = parsed.withColumn("_refused", refused).withColumn("_start", F.coalesce("_first", F.lit(0).cast("long")))
    joined = checked.join(blobs.select("path", "content"), "path")
    content, data, start = F.col("content"), F.col("data"), F.col("_start")
    turned, grow = F.col("reverse"), F.col("append_zero")
    cli = (
        F.when(overwrite & ranged, B.overwrite_range(content, first, second, data, append_zero=grow, reverse=turned))
        .when(ranged, B.insert_range(content, first, second, data, reverse=turned))
        .when(at_end, B.append_eof(content, data, turned))
        .when(overwrite, B.overwrite_at(content, start, data, append_zero=grow, reverse=turned))
        .otherwise(B.insert_at(content, start, data, reverse=turned))
    )
    inserted = B.insert_at(content, start, data, reverse=turned, dialect="gui")
    gui = (
        F.when(
            overwrite & ranged,
            B.overwrite_range(content, first, second, data, append_zero=grow, reverse=turned, dialect="gui"),
        )
        .when(overwrite, B.overwrite_at(content, start, data, append_zero=grow, reverse=turned, dialect="gui"))
        .otherwise(F.struct(inserted.alias("content"), F.lit(None).cast("string").alias("error")))
    )
    plain = F.struct(cli.alias("content"), F.when(cli.isNull(), F.lit(B.TOO_LONG)).alias("error"))
    result = F.when(F.col("_refused").isNull(), F.when(F.col("_gui"), gui).otherwise(plain))
    return joined.select("path", "seq", "_refused", result.alias("_r")).select(
        "path", "seq", "_r.content", F.coalesce("_refused", "_r.error").alias("error")
    )
