"""File actions with a journal, so that a batch that died half-way is finished and never done twice.

A batch goes through two phases. First every step is written down as an intent together with what its source is: kind, length
and time. Only when all intents are stored are the steps carried out, each by way of a name that carries the intent's
own token. Whoever repeats a step, be it a task that Spark runs again or the whole batch after a restart, can tell from
these what has happened: a file under the token's name was taken and not yet delivered, a destination that is what the
intent describes was delivered, and a source that is something else by now belongs to somebody else and is left alone.
The stored report ends the batch; a batch with a report gives that and does nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siftworks.sources.trees import open_filesystem, path_exists
from siftworks.sources.writers import RESULT_SCHEMA, _copy, last_writers

INTENTS = "source string, destination string, effect string, token string, kind string, length long, micros long"
CHANGED = "the source changed since the step was planned"
GONE = "the source went away since the step was planned"


def _state(path: str) -> tuple[str, int, int] | None:
    """Kind, length and time of what is at a path."""
    from pyarrow import fs

    filesystem, at = open_filesystem(path)
    info = filesystem.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return None
    kind = "dir" if info.type == fs.FileType.Directory else "file"
    return kind, (info.size or 0) if kind == "file" else 0, (info.mtime_ns or 0) // 1000


def _remove(path: str) -> None:
    filesystem, at = open_filesystem(path)
    if _state(path)[0] == "dir":
        filesystem.delete_dir(at)
    else:
        filesystem.delete_file(at)


def _rename(source: str, destination: str) -> None:
    """Rename within a file system; from one to another, copy under a name of its own and then remove the source."""
    source_fs, source_at = open_filesystem(source)
    dest_fs, dest_at = open_filesystem(destination)
    dest_fs.create_dir(dest_at.rsplit("/", 1)[0], recursive=True)
    if source_fs.type_name == dest_fs.type_name:
        source_fs.move(source_at, dest_at)
    else:
        _copy(source, destination)
        _remove(source)


def held_name(destination: str | None, source: str, token: str) -> str:
    """Where a step keeps what it has taken until it is delivered or removed."""
    return f"{destination}.{token}.moving" if destination else f"{source}.{token}.gone"


def _step(
    source: str, destination: str | None, effect: str, token: str, intended: tuple[str, int, int] | None
) -> tuple[bool, str | None]:
    """Carry out one intent, or what is left of it; whether it is done, and why not."""
    if effect == "copy":
        return _copy(source, destination), None
    held = held_name(destination if effect == "move" else None, source, token)
    if _state(held) is None:
        if intended is None:
            return False, None
        now = _state(source)
        if now != intended:
            # an earlier attempt may have been here
            if effect == "move" and _state(destination) == intended:
                return True, None
            if now is not None:
                return False, CHANGED
            return (True, None) if effect == "delete" else (False, GONE)
        _rename(source, held)
    if effect == "move":
        _rename(held, destination)
    else:
        _remove(held)
    return True, None


def _filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames with rows; an empty string column cannot be handed back."""
    return (frame for frame in frames if len(frame))


def prepare(plan: DataFrame, journal: str) -> DataFrame:
    """Write the intents of a batch, unless that was done before, and give them as stored."""
    spark, folder = plan.sparkSession, f"{journal.rstrip('/')}/intents"
    if not path_exists(f"{folder}/_SUCCESS"):

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in _filled(frames):
                rows = []
                for source, destination, effect in frame.itertuples(index=False):
                    named = "\0".join((journal, source, destination or "", effect))
                    token = hashlib.sha256(named.encode()).hexdigest()[:16]
                    rows.append((source, destination, effect, token, *(_state(source) or (None, None, None))))
                columns = [c.split()[0] for c in INTENTS.split(", ")]
                made = pd.DataFrame(rows, columns=columns)
                yield made.astype({"length": "Int64", "micros": "Int64"})

        steps = last_writers(plan).select("source", "destination", "effect")
        steps.mapInPandas(look, INTENTS).write.mode("overwrite").parquet(folder)
    return spark.read.schema(INTENTS).parquet(folder)


def carry_out(plan: DataFrame, journal: str) -> DataFrame:
    """Carry out the planned steps of one batch, whose own folder ``journal`` is, and report each one.

    Called again for the same folder it goes by the intents stored there, whatever ``plan`` says by then. A
    failure is a row with an error; a source that was not there to begin with is no error. Paths and the folder
    must be reachable from every executor. Rows are those of ``run_actions``.
    """
    spark, folder = plan.sparkSession, f"{journal.rstrip('/')}/report"
    if not path_exists(f"{folder}/_SUCCESS"):

        def act(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in _filled(frames):
                done, errors = [], []
                for source, destination, effect, token, kind, length, micros in frame.itertuples(index=False):
                    try:
                        intended = (kind, int(length), int(micros)) if isinstance(kind, str) else None
                        ready, error = _step(source, destination, effect, token, intended)
                    except Exception as failure:  # noqa: BLE001 - whatever fails is that row's failure
                        ready, error = False, str(failure)
                    done.append(ready)
                    errors.append(error)
                yield frame[["source", "destination", "effect"]].assign(done=done, error=errors)

        steps = prepare(plan, journal).repartition("source")
        steps.mapInPandas(act, RESULT_SCHEMA).write.mode("overwrite").parquet(folder)
    return spark.read.schema(RESULT_SCHEMA).parquet(folder)
