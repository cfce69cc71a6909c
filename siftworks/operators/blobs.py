"""Operators over tables of blobs ``(path, content BINARY)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.functions.bytes import LATIN1, ROW_BYTES, size

CHUNK_BYTES = 1 << 16


def blob_chunks(blobs: DataFrame, *, content: str = "content", chunk: int = CHUNK_BYTES) -> DataFrame:
    """Blobs cut into pieces of at most ``chunk`` bytes: the other columns, ``base`` and ``piece``.

    Row-wise views are built from pieces, so their cost per output row does not
    depend on how large the blob is.
    """
    keep = [c for c in blobs.columns if c != content]
    data = F.col(content)
    starts = F.sequence(F.lit(0).cast("long"), size(data) - 1, F.lit(chunk).cast("long"))
    pieces = F.transform(
        starts, lambda s: F.struct(s.alias("base"), F.substring(data, (s + 1).cast("int"), F.lit(chunk)).alias("piece"))
    )
    return blobs.filter(size(data) > 0).select(*keep, F.inline(pieces))


def offset_text(offset: Column) -> Column:
    digits = F.hex(offset)
    return F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)


def hex_rows(blobs: DataFrame, *, content: str = "content", base: Column | int = 0) -> DataFrame:
    """Pieces of 16 bytes: the other columns, ``row_offset`` and ``row_bytes``.

    Rows are numbered from the start of the content plus ``base``, so a byte range
    keeps the offsets it has in its file.
    """
    keep = [c for c in blobs.columns if c != content]
    base = F.lit(base).cast("long") if isinstance(base, int) else base
    chunks = blob_chunks(blobs.withColumn("_from", base), content=content)
    steps = F.sequence(F.lit(0), F.octet_length("piece") - 1, F.lit(ROW_BYTES))
    return chunks.select(*keep, "_from", "base", "piece", F.explode(steps).alias("_step")).select(
        *keep,
        (F.col("_from") + F.col("base") + F.col("_step")).alias("row_offset"),
        F.substring("piece", F.col("_step") + 1, F.lit(ROW_BYTES)).alias("row_bytes"),
    )


def row_cells(row_bytes: Column) -> Column:
    """The bytes of a row as upper-case two-digit cells."""
    return F.regexp_extract_all(F.hex(row_bytes), F.lit("(..)"), F.lit(1))


def row_gutter(row_bytes: Column) -> Column:
    """The bytes of a row as text, with a dot for whatever does not print."""
    return F.regexp_replace(F.decode(row_bytes, LATIN1), r"[^\x20-\x7E]", ".")


def hex_dump(blobs: DataFrame, *, content: str = "content", base: Column | int = 0) -> DataFrame:
    """Rows of 16 bytes: ``row_offset``, ``offset`` text, ``hex`` cells and the ``ascii`` gutter."""
    keep = [c for c in blobs.columns if c != content]
    rows, row_bytes = hex_rows(blobs, content=content, base=base), F.col("row_bytes")
    return rows.select(
        *keep,
        "row_offset",
        offset_text(F.col("row_offset")).alias("offset"),
        row_cells(row_bytes).alias("hex"),
        row_gutter(row_bytes).alias("ascii"),
    )


def scan_strings(blobs: DataFrame, *, content: str = "content", min_length: int = 4) -> DataFrame:
    """Runs of printable bytes (0x20-0x7E, tab, LF, CR) of at least ``min_length``, with their byte offset.

    No built-in function returns match positions, and rebuilding them takes a
    window per blob; an Arrow batch with a compiled bytes pattern is one pass
    without a shuffle.  Results are handed over every few thousand matches or few megabytes.
    """
    keep = [f for f in blobs.schema.fields if f.name != content]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("offset", T.LongType()), T.StructField("value", T.StringType())])
    pattern = rb"[\t\n\r\x20-\x7e]{%d,}" % max(min_length, 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = re.compile(pattern).finditer
        for batch in batches:
            source, offsets, values, held = [], [], [], 0

            def found(batch=batch) -> pa.RecordBatch:
                picked = batch.select(names).take(pa.array(source, pa.int64()))
                columns = [*picked.columns, pa.array(offsets, pa.int64()), pa.array(values, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=[*names, "offset", "value"])

            for row, blob in enumerate(batch.column(content)):
                data = blob.as_py()
                for match in finder(data or b""):
                    source.append(row)
                    offsets.append(match.start())
                    values.append(match.group().decode("ascii"))
                    held += len(values[-1])
                    if len(source) >= 8192 or held >= 16 << 20:
                        yield found()
                        source, offsets, values, held = [], [], [], 0
            yield found()

    return blobs.select(*names, content).mapInArrow(scan, schema)


def strings_filter(strings: DataFrame, needle: str = "", *, value: str = "value") -> DataFrame:
    """Strings containing ``needle`` in any case; an empty needle keeps all."""
    return strings.filter(F.contains(F.lower(F.col(value)), F.lower(F.lit(needle)))) if needle else strings


def strings_shown(strings: DataFrame, needle: str = "", *, value: str = "value") -> DataFrame:
    """One row with the number of strings kept by the filter and in total."""
    kept = F.contains(F.lower(F.col(value)), F.lower(F.lit(needle)))
    return strings.agg(F.count_if(kept).alias("kept"), F.count("*").alias("total"))


def verify_copy(source: DataFrame, copy: DataFrame, *, key: str = "path", content: str = "content") -> DataFrame:
    """Per path: digests of both sides and whether they agree; only digests are joined."""
    ours = source.select(key, F.sha2(F.col(content), 256).alias("source_sha256"))
    theirs = copy.select(key, F.sha2(F.col(content), 256).alias("copy_sha256"))
    same = F.col("source_sha256").eqNullSafe(F.col("copy_sha256"))
    return ours.join(theirs, key, "left").withColumn("identical", same)
