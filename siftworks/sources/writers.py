"""Sinks: findings as JSON or text, file copies, and the actions of a monitor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.operators.events import dest_collisions
from siftworks.operators.findings import FINDING_COLUMNS, findings_report, partition_covered
from siftworks.session import work_dir
from siftworks.sources.trees import open_filesystem

RESULT_SCHEMA = "source string, destination string, effect string, done boolean, error string"


def findings_json_sink(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in one folder per status: ``status=active`` and ``status=covered``."""
    rows = partition_covered(findings).select("status", *[c for c in FINDING_COLUMNS if c != "severity_rank"])
    rows.write.mode(mode).partitionBy("status").json(path)


def findings_text_sink(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One plain text block per finding."""
    findings.select(findings_report().alias("value")).write.mode(mode).text(path)


def _copy(source: str, destination: str) -> bool:
    """Copy one file under a temporary name, then rename: a repeated or lost task leaves no partial file."""
    from pyarrow import fs

    source_fs, source_path = open_filesystem(source)
    dest_fs, dest_path = open_filesystem(destination)
    if source_fs.get_file_info(source_path).type != fs.FileType.File:
        return False
    dest_fs.create_dir(dest_path.rsplit("/", 1)[0], recursive=True)
    partial = f"{dest_path}.{uuid.uuid4().hex}.part"
    try:
        with source_fs.open_input_stream(source_path) as reader, dest_fs.open_output_stream(partial) as writer:
            while block := reader.read(1 << 20):
                writer.write(block)
        dest_fs.move(partial, dest_path)
    except BaseException:
        if dest_fs.get_file_info(partial).type == fs.FileType.File:
            dest_fs.delete_file(partial)
        raise
    return True


def _delete(source: str) -> bool:
    from pyarrow import fs

    source_fs, path = open_filesystem(source)
    kind = source_fs.get_file_info(path).type
    if kind == fs.FileType.File:
        source_fs.delete_file(path)
    elif kind == fs.FileType.Directory:
        source_fs.delete_dir(path)
    return kind != fs.FileType.NotFound


def _move(source: str, destination: str) -> bool:
    from pyarrow import fs

    source_fs, path = open_filesystem(source)
    dest_fs, dest_path = open_filesystem(destination)
    if source_fs.get_file_info(path).type == fs.FileType.NotFound:
        # moved by an earlier attempt of this task
        return dest_fs.get_file_info(dest_path).type != fs.FileType.NotFound
    dest_fs.create_dir(dest_path.rsplit("/", 1)[0], recursive=True)
    if source_fs.type_name == dest_fs.type_name:
        source_fs.move(path, dest_path)
        return True
    return _copy(source, destination) and _delete(source)


def _act(effect: str, source: str, destination: str | None) -> bool:
    if effect == "copy":
        return _copy(source, destination)
    if effect == "move":
        return _move(source, destination)
    return _delete(source)


def last_writers(plan: DataFrame) -> DataFrame:
    """One step per source. Where sources collide on a destination, the last writer gets it.

    A copy that would be overwritten is left out; a move that would be overwritten
    only removes its source.
    """
    steps = plan.select("source", "destination", "effect").distinct()
    # steps without a destination have no rival and would all meet under one key
    alone = steps.filter(F.col("destination").isNull())
    winners = dest_collisions(plan).select("destination", "winner")
    joined = steps.filter(F.col("destination").isNotNull()).join(winners, "destination", "left")
    wins = F.col("winner").isNull() | (F.col("winner") == F.col("source"))
    kept = joined.filter(wins | (F.col("effect") == "move"))
    return alone.unionByName(kept.select(
        "source",
        F.when(wins, F.col("destination")).alias("destination"),
        F.when(wins, F.col("effect")).otherwise(F.lit("delete")).alias("effect"),
    ))


def run_actions(plan: DataFrame, *, dry_run: bool = True, report: str | None = None) -> DataFrame:
    """Carry out planned steps on the executors and report each one; a failure is a row, not an exception.

    Paths must be reachable from every executor.  A missing source is no error.
    A dry run, the default, only reports what would be done.  The steps are carried out by this call,
    once: their report is written to the new folder ``report`` (by default one in the shared folder) and read back.
    A step that a lost task has done already counts as done.
    """
    steps = last_writers(plan)
    if dry_run:
        return steps.select(
            "source", "destination", "effect", F.lit(False).alias("done"), F.lit(None).cast("string").alias("error")
        )

    def act(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done, errors = [], []
            for source, destination, effect in frame.itertuples(index=False):
                try:
                    done.append(_act(effect, source, destination))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - whatever fails is that row's failure
                    done.append(False)
                    errors.append(str(error))
            yield frame.assign(done=done, error=errors)

    folder = report or work_dir(plan.sparkSession, "actions")
    steps.mapInPandas(act, RESULT_SCHEMA).write.mode("overwrite").parquet(folder)
    return plan.sparkSession.read.schema(RESULT_SCHEMA).parquet(folder)


def copy_files(pairs: DataFrame) -> DataFrame:
    """Copy ``(source, destination)`` pairs and report each; compare with ``verify_copy`` afterwards."""
    plan = pairs.select(
        "source", "destination", F.lit("copy").alias("effect"), F.lit(0).alias("ts_micros"), F.lit(0).alias("seq")
    )
    return run_actions(plan, dry_run=False)
