"""The file tree as edges (parent, name, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions import scalars
from lithos.operators.pieces import cut

#: Levels of joins that a plan holds before it is cut.
LEVELS = 16


def components(paths: DataFrame, key: str, path: str) -> DataFrame:
    """key, depth (from 1), name: a row for each component."""
    rows = paths.select(key, F.posexplode_outer(scalars.path_parts(F.col(path))).alias("depth", "name"))
    return rows.filter(F.col("name").isNotNull()).select(key, (F.col("depth") + 1).cast("long").alias("depth"), "name")


def resolve(paths: DataFrame, edges: DataFrame, root: str = "/") -> DataFrame:
    """path, child: the node of each path, null if there is none. One join for each level that some
    path has."""
    state = paths.select("path", scalars.path_parts(F.col("path")).alias("_parts"), F.lit(root).alias("child"))
    deepest = state.agg(F.max(F.size("_parts"))).first()[0] or 0
    for level in range(deepest):
        step = edges.select(F.col("parent").alias("child"), F.col("name").alias("_name"), F.col("child").alias("_next"))
        asked = state.withColumn("_name", F.when(F.size("_parts") > level, F.get("_parts", F.lit(level))))
        found = asked.join(step, ["child", "_name"], "left")
        state = found.select("path", "_parts", F.when(F.col("_name").isNull(), F.col("child")).otherwise(F.col("_next")).alias("child"))
        if level % LEVELS == LEVELS - 1:
            state = cut(state)
    return state.select("path", "child")


def listing(edges: DataFrame, parent: str) -> DataFrame:
    """Names and nodes of a directory, by name."""
    return edges.filter(F.col("parent") == parent).select("name", "child").orderBy("name")


def child_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.count("*").alias("n_children"))


def subtree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth of everything below roots (node), level by level until none is new; a node
    that several ways lead to has the least depth, and a way back to it is no further level."""
    level = cut(roots.select(F.col("node").alias("root"), F.col("node"), F.lit(0).cast("long").alias("depth")).distinct())
    out, below, depth = level, edges.select(F.col("parent").alias("node"), F.col("child").alias("next")), 0
    while not level.isEmpty():
        depth += 1
        level = level.join(below, "node").select("root", F.col("next").alias("node"), F.lit(depth).cast("long").alias("depth")).distinct()
        level = cut(level.join(out.select("root", "node"), ["root", "node"], "left_anti"))
        out = out.unionByName(level)
        if depth % LEVELS == 0:
            out = cut(out)
    return out


def lengths_below(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """node, total: each directory's length with all that is below (each link counts); lengths: node,
    length. Sums roll up level by level, at most a row for each directory in one. A directory within
    itself is an error."""
    ways = edges.select("parent", F.col("child").alias("node"))
    flow, totals = lengths.select("node", "length"), None
    directories = ways.select("parent").distinct().count()
    for level in range(directories + 1):
        flow = cut(flow.join(ways, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("length").alias("length")))
        if totals is not None and flow.isEmpty():
            return totals.groupBy("node").agg(F.sum("length").alias("total"))
        totals = flow if totals is None else totals.unionByName(flow)
        if level % LEVELS == LEVELS - 1:
            totals = cut(totals.groupBy("node").agg(F.sum("length").alias("length")))
    if directories:
        raise ValueError("a directory is within itself")
    return flow.select("node", F.col("length").alias("total"))


def created(edges: DataFrame, new: DataFrame, exclusive: bool = True) -> DataFrame:
    """Edges with new ones (parent, name, child). If a name is taken that is an error when
    exclusive; else the existing child stays."""
    taken = edges.select("parent", "name", F.lit(True).alias("_taken"))
    joined = new.join(taken, ["parent", "name"], "left")
    if exclusive:
        joined = joined.withColumn("name", F.when(F.col("_taken").isNotNull(), F.raise_error(F.concat(F.lit("exists: "), F.col("name")))).otherwise(F.col("name")))
        return edges.unionByName(joined.drop("_taken"))
    return edges.unionByName(joined.filter(F.col("_taken").isNull()).drop("_taken"))


def replaced(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones in place of those of the same name (a symlink that isn't exclusive)."""
    return edges.join(new.select("parent", "name"), ["parent", "name"], "left_anti").unionByName(new)


def linked(edges: DataFrame, links: DataFrame, directories: DataFrame) -> DataFrame:
    """Hard links; a directory (node) can't be linked and names must be free."""
    checked = links.join(directories.select(F.col("node").alias("child"), F.lit(True).alias("_dir")), "child", "left")
    checked = checked.withColumn("name", F.when(F.col("_dir").isNotNull(), F.raise_error(F.lit("a directory can't be linked"))).otherwise(F.col("name"))).drop("_dir")
    return created(edges, checked.select("parent", "name", "child"))


def deleted(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without (parent, name) pairs; a directory that has children can't go."""
    victims = edges.join(gone.select("parent", "name"), ["parent", "name"], "left_semi")
    full = victims.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").limit(1)
    if not full.isEmpty():
        raise ValueError("a directory isn't empty")
    return edges.join(gone.select("parent", "name"), ["parent", "name"], "left_anti")


def deleted_paths(edges: DataFrame, paths: DataFrame, root: str = "/") -> DataFrame:
    """Edges without those that paths (path) lead to. Paths are absolute and not the root; a path
    that leads nowhere changes nothing."""
    bad = ~F.col("path").startswith("/") | (F.size(scalars.path_parts(F.col("path"))) == 0)
    asked = paths.select(F.when(bad, F.raise_error(F.concat(F.lit("can't delete "), F.col("path")))).otherwise(F.col("path")).alias("_path"))
    asked = asked.select(scalars.parent_path(F.col("_path")).alias("path"), scalars.leaf_name(F.col("_path")).alias("name"))
    parents = resolve(asked.select("path").distinct(), edges, root).filter(F.col("child").isNotNull())
    return deleted(edges, asked.join(parents, "path").select(F.col("child").alias("parent"), "name").distinct())


def moved(edges: DataFrame, parent: str, name: str, to_parent: str, to_name: str) -> DataFrame:
    """One edge moved: same child, other place, in one step."""
    if not edges.filter((F.col("parent") == to_parent) & (F.col("name") == to_name)).isEmpty():
        raise ValueError("the target exists")
    here = (F.col("parent") == parent) & (F.col("name") == name)
    return edges.select(F.when(here, to_parent).otherwise(F.col("parent")).alias("parent"), F.when(here, to_name).otherwise(F.col("name")).alias("name"), "child")


def child_info(edges: DataFrame, nodes: DataFrame, parent: str, keys: list[str]) -> DataFrame:
    """For each child that can be read the metadata of the keys asked for; nodes: node, metadata."""
    wanted = F.array(*[F.lit(k) for k in keys])
    children = edges.filter(F.col("parent") == parent).select("name", F.col("child").alias("node"))
    return children.join(nodes, "node").select("name", scalars.map_only(F.col("metadata"), wanted).alias("metadata")).orderBy("name")
