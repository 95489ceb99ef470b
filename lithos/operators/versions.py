"""Versions and snapshots. The order of versions is (versiontime, uniquifier)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators import pieces

ORDER = ["versiontime", "uniquifier"]


def stamp() -> Column:
    return F.struct(*ORDER)


def _stamp(at: tuple[int, int]) -> Column:
    return F.struct(F.lit(at[0]).cast("long").alias("versiontime"), F.lit(at[1]).cast("int").alias("uniquifier"))


def exact(rows: DataFrame, versions: DataFrame, data: DataFrame, targets: DataFrame) -> DataFrame:
    """The data of segments at exactly the versions asked for: rows (segment, versionid, dataid),
    versions (versionid, time, uniquifier), data (dataid, ...), targets (segment, time, uniquifier).

    Each join is on a unique key, so that none makes more rows than it reads, whether or not stamps
    are unique over segments; rows of segments that nobody asks for go first."""
    asked = rows.join(targets.select("segment").distinct(), "segment", "left_semi")
    return targets.join(asked.join(versions, "versionid"), ["segment", *ORDER]).join(data, "dataid")


def nearest(versions: DataFrame, targets: DataFrame, mode: str = "lexicographic") -> DataFrame:
    """For each target (segment, at_time, at_uniquifier) the last version at or before it.

    mode "component" asks for both parts to be at most the target's, which skips (10, 7) for the
    target (15, 0). The versions are aggregated as they are read: no sort, one row for each target. A
    version is read once for each target of its segment; for many targets there is `nearest_each`."""
    joined = versions.join(targets, "segment")
    time, uniq = F.col("versiontime"), F.col("uniquifier")
    if mode == "component":
        there = (time <= F.col("at_time")) & (uniq <= F.col("at_uniquifier"))
    else:
        there = (time < F.col("at_time")) | (time == F.col("at_time")) & (uniq <= F.col("at_uniquifier"))
    others = [c for c in versions.columns if c not in ("segment", *ORDER)]
    last = joined.filter(there).groupBy("segment", "at_time", "at_uniquifier").agg(F.max(F.struct(*ORDER, *others)).alias("last"))
    return last.select("segment", "at_time", "at_uniquifier", *[F.col(f"last.{c}").alias(c) for c in (*ORDER, *others)])


def nearest_each(versions: DataFrame, targets: DataFrame, large: int = pieces.LARGE) -> DataFrame:
    """The same as `nearest`, lexicographic, for many targets of a segment: versions and targets are
    sorted together, and each target takes the last version before it."""
    others = [c for c in versions.columns if c not in ("segment", *ORDER)]
    state = F.struct(*ORDER, *others)
    seen = versions.select("segment", *ORDER, F.lit(0).alias("_target"), state.alias("_state"))
    asked = targets.select("segment", F.col("at_time").alias("versiontime"), F.col("at_uniquifier").alias("uniquifier"), F.lit(1).alias("_target"))
    found = pieces.last_before(seen.unionByName(asked, allowMissingColumns=True), "segment", [*ORDER, "_target"], "_state", large)
    found = found.filter((F.col("_target") == 1) & F.col("_state").isNotNull())
    return found.select("segment", F.col("versiontime").alias("at_time"), F.col("uniquifier").alias("at_uniquifier"), *[F.col(f"_state.{c}").alias(c) for c in (*ORDER, *others)])


def as_of(versions: DataFrame, default: tuple[int, int] | None) -> DataFrame:
    """What a session reads that has set a default version: each segment's last version up to it."""
    return latest(versions if default is None else versions.filter(F.col("versiontime") <= default[0]).filter(stamp() <= _stamp(default)))


def last_modified(versions: DataFrame) -> DataFrame:
    """segment, last_modified: the time of its last version."""
    return versions.groupBy("segment").agg(F.max("versiontime").alias("last_modified"))


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each segment."""
    others = [c for c in versions.columns if c not in ("segment", *ORDER)]
    return versions.groupBy("segment").agg(F.max(F.struct(*ORDER, *others)).alias("last")).select("segment", *[F.col(f"last.{c}").alias(c) for c in (*ORDER, *others)])


def history(versions: DataFrame) -> DataFrame:
    """Every version of each segment with its place in order, from 1."""
    return pieces.numbered(versions, "segment", ORDER, "_ordinal").withColumn("ordinal", F.col("_ordinal").cast("int")).drop("_ordinal")


def in_range(versions: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Versions from `first` to `last`, both included; the bound on time alone reaches the scan."""
    return versions.filter(F.col("versiontime").between(first[0], last[0])).filter((stamp() >= _stamp(first)) & (stamp() <= _stamp(last)))


def stamped(commits: DataFrame) -> DataFrame:
    """Commits (versionid, millis) with a uniquifier: 0, 1, … among those of one millisecond."""
    return pieces.numbered(commits, "millis", ["versionid"], "_place").withColumn("uniquifier", (F.col("_place") - 1).cast("int")).drop("_place")


def overlaid(committed: DataFrame, dirty: DataFrame, key: str = "segment") -> DataFrame:
    """Rows of a transaction's own view: what it wrote hides what is committed."""
    return committed.join(dirty.select(key), key, "left_anti").unionByName(dirty)


def changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """added, deleted and modified entries between two states; a null value is a value."""
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    there = lambda df, name: df.withColumn("_there", F.lit(True)).alias(name)
    joined = there(before, "a").join(there(after, "b"), key, "full_outer")
    kind = F.when(F.col("a._there").isNull(), "added").when(F.col("b._there").isNull(), "deleted").when(~a.eqNullSafe(b), "modified")
    return joined.select(*key, kind.alias("change"), a.alias("before"), b.alias("after")).filter(F.col("change").isNotNull())


def with_snapshot(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots by (volume, name), new ones in place of those of the same name."""
    return overlay_by(snapshots, new, ["volume", "name"])


def overlay_by(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(new.select(*key), key, "left_anti").unionByName(new)


def release_snapshot(snapshots: DataFrame, volume: int, name: str) -> DataFrame:
    return snapshots.filter(~((F.col("volume") == volume) & (F.col("name") == name)))


def list_snapshots(snapshots: DataFrame, volume: int) -> DataFrame:
    return snapshots.filter(F.col("volume") == volume).orderBy(*ORDER, "name")

