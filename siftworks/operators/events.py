"""File events: filtering, debouncing, planning of actions, and events derived from two inventories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.paths import dest_path, path_depth_ok
from siftworks.operators.ranking import ranked

# Event kinds, the details that make a modification a rename, and the actions.
KINDS = ("create", "modify", "remove", "access", "other")
RENAMES = ("name_from", "name_to", "name_both", "name_any")
ACTIONS = ("copy", "move", "delete")

# Slots of a path that are put in order by one task.
STRETCH = 4096


@dataclass(frozen=True)
class MonitorOptions:
    """What to watch and what to do; ``check`` raises ``ValueError`` on an unusable combination."""

    targets: tuple[str, ...]
    action: str
    dest: str | None = None
    on_create: bool = False
    on_modify: bool = False
    on_rename: bool = False
    on_delete: bool = False
    recursive: bool = True
    debounce_ms: int = 300

    def check(self) -> MonitorOptions:
        if not self.targets:
            raise ValueError("no targets specified")
        if not (self.on_create or self.on_modify or self.on_rename or self.on_delete):
            raise ValueError("no events enabled: switch on create, modify, rename or delete")
        if self.action not in ACTIONS:
            raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
        if self.action != "delete" and self.dest is None:
            raise ValueError("copy and move need a destination")
        return self


def event_filter(
    *, on_create: bool = False, on_modify: bool = False, on_rename: bool = False, on_delete: bool = False
) -> Column:
    """Does an event trigger? A rename of an unlisted kind counts as a modification."""
    rename = F.coalesce(F.col("kind_detail").isin(*RENAMES), F.lit(False))
    kind = F.col("kind")
    return (
        F.when(kind == "create", F.lit(on_create))
        .when(kind == "remove", F.lit(on_delete))
        .when((kind == "modify") & rename, F.lit(on_rename))
        .when(kind == "modify", F.lit(on_modify))
        .otherwise(F.lit(False))
    )


def event_filter_coarse(
    *, on_create: bool = False, on_modify: bool = False, on_rename: bool = False, on_delete: bool = False
) -> Column:
    """The same without looking at details: renames are modifications and ``on_rename`` has no effect."""
    kind = F.col("kind")
    return (
        F.when(kind == "create", F.lit(on_create))
        .when(kind == "modify", F.lit(on_modify))
        .when(kind == "remove", F.lit(on_delete))
        .otherwise(F.lit(False))
    )


def watched(targets: Sequence[str], recursive: bool = True) -> Column:
    """Is the path one of the targets or below one?"""
    result = F.lit(False)
    for target in targets:
        result = result | path_depth_ok(F.col("path"), target, recursive)
    return result


def select_events(events: DataFrame, options: MonitorOptions) -> DataFrame:
    """Events of watched paths that trigger; works on batches and streams alike."""
    wanted = event_filter(
        on_create=options.on_create,
        on_modify=options.on_modify,
        on_rename=options.on_rename,
        on_delete=options.on_delete,
    )
    return events.filter(wanted & watched(options.targets, options.recursive))


def debounce(events: DataFrame, gap_micros: int, *, order: str = "seq") -> DataFrame:
    """Bursts of events on one path, ended by a pause longer than the gap, as their last event.

    ``events(path, ts_micros, kind, kind_detail, <order>)``.  Events in one
    gap-wide slot of time always belong to the same burst, so they are reduced to
    one row per (path, slot) before the shuffle.  Slots meet in windows over stretches of
    ``STRETCH`` slots of a path, and only one row per stretch meets in the windows over a whole path,
    so a path that is busy for years is still shared by many tasks.
    """
    last = F.struct("kind", "kind_detail", F.col(order).alias("last_order"))
    slots = (
        events.withColumn("_slot", F.floor(F.col("ts_micros") / F.lit(gap_micros)))
        .groupBy("path", "_slot")
        .agg(
            F.min("ts_micros").alias("_from"),
            F.max("ts_micros").alias("_to"),
            F.count("*").alias("_n"),
            F.max_by(last, F.struct("ts_micros", order)).alias("_last"),
        )
    )
    stretched = slots.withColumn("_stretch", F.floor(F.col("_slot") / F.lit(STRETCH)))
    by_slot = Window.partitionBy("path", "_stretch").orderBy("_slot")
    by_stretch = Window.partitionBy("path").orderBy("_stretch")
    ends = stretched.groupBy("path", "_stretch").agg(F.max("_to").alias("_end"))
    ends = ends.select("path", "_stretch", F.lag("_end").over(by_stretch).alias("_end_before"))
    before = F.coalesce(F.lag("_to").over(by_slot), F.col("_end_before"))
    pause = F.coalesce(F.col("_from") - before > gap_micros, F.lit(True))
    marked = stretched.join(ends, ["path", "_stretch"]).withColumn("_opened", F.when(pause, F.col("_slot")))
    # a burst is known by the slot that opens it, which may lie in an earlier stretch
    earlier = by_stretch.rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("path", "_stretch").agg(F.max("_opened").alias("_last"))
    carried = carried.select("path", "_stretch", F.max("_last").over(earlier).alias("_carried"))
    burst = F.coalesce(F.max("_opened").over(by_slot.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    bursts = marked.join(carried, ["path", "_stretch"]).withColumn("_burst", burst)
    return (
        bursts.groupBy("path", "_burst")
        .agg(
            F.min("_from").alias("first_micros"),
            F.max("_to").alias("last_micros"),
            F.sum("_n").alias("events"),
            F.max_by("_last", "_slot").alias("_last"),
        )
        .select("path", "first_micros", "last_micros", "events", "_last.kind", "_last.kind_detail", "_last.last_order")
    )


def events_x_inventory(events: DataFrame, inventory: DataFrame, action: str) -> DataFrame:
    """Events whose path can be acted on: a file to copy, anything to move or delete."""
    present = inventory.filter("is_file") if action == "copy" else inventory.filter("is_file OR is_dir")
    return events.join(present.select("path"), "path", "left_semi")


def plan_actions(events: DataFrame, action: str, dest: str | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """Add ``source, destination, effect``; with an inventory, events without a usable source drop out."""
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
    if action != "delete" and dest is None:
        raise ValueError("copy and move need a destination")
    usable = events if inventory is None else events_x_inventory(events, inventory, action)
    destination = F.lit(None).cast("string") if action == "delete" else dest_path(F.col("path"), dest)
    return usable.select(
        *usable.columns,
        F.col("path").alias("source"),
        destination.alias("destination"),
        F.lit(action).alias("effect"),
    )


def dest_collisions(plan: DataFrame, order: Sequence[str] = ("ts_micros", "seq")) -> DataFrame:
    """Per destination: how often and from how many sources it is written, and the source that is left.

    Two aggregations, first per (destination, source), so that a name shared by
    very many files is reduced before it is brought together.
    """
    latest = F.struct(*order)
    per_source = (
        plan.filter(F.col("destination").isNotNull())
        .groupBy("destination", "source")
        .agg(F.count("*").alias("_n"), F.max(latest).alias("_latest"))
    )
    return per_source.groupBy("destination").agg(
        F.sum("_n").alias("writes"),
        F.count("*").alias("sources"),
        F.max_by("source", "_latest").alias("winner"),
    )


def manifest_diff(old: DataFrame, new: DataFrame, digits: int = 3) -> DataFrame:
    """Events that lead from one inventory to another: ``(kind, kind_detail, path, from_path)``.

    Inventories are ``(path, length, modified, sha256)``.  A removed and a created
    path with the same digest are a rename; among several copies of one content
    they are paired in the order of their hashed paths, which lets a digest shared
    by a large part of all files be ranked in ``16 ** digits`` pieces; take more digits
    where a piece of the commonest content would be too long for a task.
    """
    facts = ("length", "modified", "sha256")
    before = old.select("path", F.struct(*facts).alias("_before"))
    after = new.select("path", F.struct(*facts).alias("_after"))
    gone, arrived = F.col("_after").isNull(), F.col("_before").isNull()
    kind = F.when(gone, F.lit("remove")).when(arrived, F.lit("create")).otherwise(F.lit("modify"))
    changes = (
        before.join(after, "path", "full")
        .filter(~F.col("_before").eqNullSafe(F.col("_after")))
        .select("path", kind.alias("kind"), F.coalesce("_after.sha256", "_before.sha256").alias("_sha256"))
    )
    # a changed file, or one without a digest, is a group of its own
    alone = (F.col("kind") == "modify") | F.col("_sha256").isNull()
    grouped = changes.select(
        "path",
        "kind",
        F.when(alone, F.concat(F.lit("path:"), F.col("path"))).otherwise(F.col("_sha256")).alias("_group"),
        F.md5("path").alias("_order"),
    )
    bucket = F.conv(F.substring("_order", 1, digits), 16, 10).cast("long")
    numbered = ranked(grouped, ["_group", "kind"], bucket, ["_order", "path"], name="_nth")

    def path_of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("path")))

    pairs = numbered.groupBy("_group", "_nth").agg(
        path_of("modify").alias("_modified"), path_of("remove").alias("_removed"), path_of("create").alias("_created")
    )
    modified = F.col("_modified").isNotNull()
    renamed = F.col("_created").isNotNull() & F.col("_removed").isNotNull()
    return pairs.select(
        F.when(modified | renamed, F.lit("modify"))
        .when(F.col("_created").isNull(), F.lit("remove"))
        .otherwise(F.lit("create"))
        .alias("kind"),
        F.when(modified, F.lit("data")).when(renamed, F.lit("name_both")).alias("kind_detail"),
        F.coalesce("_modified", "_created", "_removed").alias("path"),
        F.when(renamed, F.col("_removed")).alias("from_path"),
    )
