"""Files of any size as a table of chunks ``(path, chunk_no, content)`` filled by ranged reads.

A blob in one value ends at 2 GB and in one task. Here a file is planned as rows without content first; filters on
path and chunk number, or a byte range, leave only the rows that are wanted, and those alone are read, each from its
own place in the file. Lines and strings that lie across a border of chunks are put together again from the pieces at
the borders; everything inside a chunk never leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.functions.bytes import I64_MAX, LATIN1, PAGE_BYTES, SHORT_BUFFER, resolve_offset
from siftworks.session import staged
from siftworks.sources.trees import open_filesystem

CHUNK_BYTES = 8 << 20
BATCH_BYTES = 32 << 20
BATCH_STRINGS = 50_000  # strings that are handed over at once
MOST_VALUE = 1 << 30  # bytes of a string that is still given as a value


def plan_chunks(files: DataFrame, *, chunk: int = CHUNK_BYTES, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """``(<files>, chunk_no, start, size)`` for ``files(root, path, length, ...)``; nothing is read.

    With ``first`` and ``last``, offsets of a row that count from 0 and include both ends, only chunks that they
    touch are planned, cut to them. Empty files and ranges have no chunk.
    """
    last = F.col("length") - 1 if last is None else F.least(last, F.col("length") - 1)
    first = F.lit(0).cast("long") if first is None else first
    wanted = files.select("*", first.alias("_first"), last.alias("_last")).where("_first >= 0 AND _first <= _last")
    numbers = F.sequence(F.floor(F.col("_first") / chunk), F.floor(F.col("_last") / chunk))
    rows = wanted.select("*", F.explode(numbers).alias("chunk_no"))
    start = F.greatest(F.col("chunk_no") * chunk, F.col("_first"))
    end = F.least((F.col("chunk_no") + 1) * chunk, F.col("_last") + 1)
    return rows.withColumn("start", start).withColumn("size", end - start).drop("_first", "_last")


def read_chunks(plan: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Add ``content``: the planned bytes, read from their place in the file. Chunks of unreadable files drop out.

    Planned chunks are dealt over ``tasks``, so the chunks of one large file are read by many.
    """
    schema = T.StructType([*plan.schema.fields, T.StructField("content", T.BinaryType())])
    names = plan.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, contents, held = [], [], 0

            def flush(batch=batch) -> pa.RecordBatch:
                picked = batch.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*picked.columns, pa.array(contents, pa.binary())], names=[*names, "content"])

            places = zip(*[batch.column(n).to_pylist() for n in ("root", "path", "start", "size")], strict=True)
            for row, (root, path, start, size) in enumerate(places):
                filesystem, base = open_filesystem(root)
                try:
                    with filesystem.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                        data = file.read_at(size, start)
                except OSError:
                    continue
                rows.append(row)
                contents.append(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield flush()
                    rows, contents, held = [], [], 0
            yield flush()

    dealt = plan.repartition(tasks or plan.sparkSession.sparkContext.defaultParallelism * 4, "path", "chunk_no")
    return dealt.mapInArrow(run, schema)


def range_bounds(length: Column, start: Column | int, end: Column | int | None, dialect: str = "cli") -> Column:
    """Where ``byte_range`` reads, from the length alone: a struct ``(first, last, error)``; ``last`` before ``first`` is nothing."""
    start, none = F.lit(start).cast("long") if isinstance(start, int) else start.cast("long"), F.lit(None).cast("string")
    end = F.lit(end).cast("long") if isinstance(end, int) else end
    if dialect == "cli":
        if end is None:
            first, last, error = resolve_offset(start, length), length - 1, none
        else:
            first = F.when(start < 0, length + start).otherwise(start)
            last = F.when(end < 0, length + end).otherwise(end)
            last = F.when((first >= 0) & (last >= first), F.least(last, length - 1)).otherwise(F.lit(-1))
            first, error = F.greatest(first, F.lit(0)), none
    elif dialect == "gui":
        first, to_end = resolve_offset(start, length), F.greatest(length - 1, F.lit(0))
        last = to_end if end is None else F.when(end == I64_MAX, to_end).otherwise(resolve_offset(end, length))
        failed = (first <= last) & (first < length) & (last >= length)
        error = F.when(failed, F.lit(SHORT_BUFFER))
        last = F.when(failed | (first >= length), F.lit(-1)).otherwise(last)
    else:
        raise ValueError("dialect must be cli or gui")
    return F.struct(first.alias("first"), last.cast("long").alias("last"), error.alias("error"))


def read_range(files: DataFrame, first: Column, last: Column, *, chunk: int = CHUNK_BYTES, key: str = "path") -> DataFrame:
    """``(<key>, content)``: the bytes of one range for each row, empty for an empty range; reads those bytes only.

    One range of a row is one value here; for longer ones take the rows of ``read_chunks(plan_chunks(...))``.
    """
    read = read_chunks(plan_chunks(files, chunk=chunk, first=first, last=last))
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", F.hex("content").alias("digits"))))
    whole = read.groupBy(key).agg(F.unhex(F.array_join(F.transform(pieces, lambda p: p["digits"]), "")).alias("content"))
    return files.select(key).join(whole, key, "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def read_page(files: DataFrame, offset: Column | int, page: int = PAGE_BYTES, **options) -> DataFrame:
    """The page of bytes that starts at an offset, clamped to the file, as ``byte_page`` gives it of a blob."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    first = F.greatest(offset.cast("long"), F.lit(0))
    return read_range(files, first, first + (page - 1), **options)


def chunk_lines(chunks: DataFrame, *keys: str) -> DataFrame:
    """``(<keys>, line_no, line)`` of text files given as chunks ``(<keys>, chunk_no, content)``.

    Lines and what drops out are those of ``decode_text`` and ``explode_lines``: line feeds end lines, with a
    carriage return before them; files that are not valid UTF-8 are left out as a whole. Chunks are read twice, once
    to count line breaks.
    """
    names = list(keys) or ["path"]
    # as Latin-1 every byte is a character, so a border within a character does no harm
    pieces = F.split(F.decode("content", LATIN1), "\n")
    counts = chunks.select(*names, "chunk_no", (F.size(pieces) - 1).cast("long").alias("_breaks"))
    before = Window.partitionBy(*names).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    sums = counts.select(
        *names, "chunk_no", F.coalesce(F.sum("_breaks").over(before), F.lit(0)).alias("_before"), F.sum("_breaks").over(whole).alias("_all")
    )
    cut = chunks.select(*names, "chunk_no", pieces.alias("_pieces"))
    cut = cut.join(sums, [*names, "chunk_no"]).withColumn("_last", F.size("_pieces") - 1)
    rows = cut.select(*names, "chunk_no", "_before", "_all", "_last", F.posexplode("_pieces").alias("_at", "_piece"))
    rows = rows.select(*names, "chunk_no", "_all", "_last", "_at", (F.col("_before") + F.col("_at")).alias("_line"), "_piece")
    inner = (F.col("_at") > 0) & (F.col("_at") < F.col("_last"))
    inside = rows.where(inner).select(*names, "_line", "_all", F.col("_piece").alias("_bytes"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "_piece")))
    across = rows.where(~inner).groupBy(*names, "_line", "_all").agg(F.array_join(F.transform(parts, lambda p: p["_piece"]), "").alias("_bytes"))
    ended = F.col("_line") < F.col("_all")
    lines = inside.unionByName(across).where(ended | (F.col("_bytes") != ""))
    returned = ended & F.endswith("_bytes", F.lit("\r"))
    text = F.encode(F.when(returned, F.left("_bytes", F.length("_bytes") - 1)).otherwise(F.col("_bytes")), LATIN1).cast("string")
    found = lines.select(*names, (F.col("_line") + 1).cast("int").alias("line_no"), text.alias("line"))
    broken = found.where(~F.is_valid_utf8("line")).select(*names).distinct()
    return found.join(broken, names, "left_anti")


def chunk_strings(chunks: DataFrame, *keys: str, min_length: int = 4) -> DataFrame:
    """``(<keys>, offset, length, value)``: the runs of printable bytes of files given as chunks, as ``scan_strings`` finds them.

    A run that touches a border is a piece; pieces that follow each other without a gap are one string. One of more than
    a gigabyte has its length and no value; its bytes are a range to read. What is found is stored before it is used more
    than once, so each chunk is read once.
    """
    names = list(keys) or ["path"]
    fields = [f for f in chunks.schema.fields if f.name in names]
    own = [f.name for f in fields]
    extra = [("offset", T.LongType()), ("length", T.LongType()), ("value", T.StringType()), ("_border", T.BooleanType())]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in extra]])
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = re.compile(rb"[\t\n\r\x20-\x7e]+").finditer
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for batch in batches:
            rows, found, held = [], [], 0

            def flush(batch=batch) -> pa.RecordBatch:
                told = batch.select(own).take(pa.array(rows, pa.int64()))
                rest = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*told.columns, *rest], names=columns)

            starts = batch.column("start").to_pylist()
            for row, content in enumerate(batch.column("content")):
                data = content.as_py() or b""
                for match in finder(data):
                    first, end = match.span()
                    border = first == 0 or end == len(data)
                    if border or end - first >= min_length:
                        rows.append(row)
                        found.append((starts[row] + first, end - first, match.group().decode("ascii"), border))
                        held += end - first
                        if len(rows) >= BATCH_STRINGS or held >= BATCH_BYTES:
                            yield flush()
                            rows, found, held = [], [], 0
            yield flush()

    found = staged(chunks.select(*own, "start", "content").mapInArrow(run, schema), "strings")
    inside = found.where("NOT _border").select(*names, "offset", "length", "value")
    pieces = found.where("_border")
    order = Window.partitionBy(*names).orderBy("offset")
    light = pieces.select(*names, "offset", "length").dropna(subset=names)
    gap = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order) != F.col("offset"), F.lit(True))
    opened = light.withColumn("_open", F.when(gap, F.col("offset")))
    island = F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = opened.select(*names, "offset", "length", island.alias("_string"))
    # the order is one of light rows of a file, and the sums need no shuffle after it
    total = F.sum("length").over(Window.partitionBy(*names, "_string"))
    kept = placed.select(*names, "offset", "_string", total.alias("_total")).where(F.col("_total") >= min_length)
    small = kept.where(F.col("_total") <= MOST_VALUE)
    texts = pieces.select(*names, "offset", "value").join(small, [*names, "offset"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "value")))
    values = texts.groupBy(*names, "_string", "_total").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))
    across = values.select(*names, F.col("_string").alias("offset"), F.col("_total").alias("length"), "value")
    large = kept.where((F.col("_total") > MOST_VALUE) & (F.col("offset") == F.col("_string")))
    beyond = large.select(*names, "offset", F.col("_total").alias("length"), F.lit(None).cast("string").alias("value"))
    return inside.unionByName(across).unionByName(beyond)
