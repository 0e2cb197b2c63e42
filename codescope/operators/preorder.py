"""What follows from the order and depth of a tree's nodes alone: parents, places among siblings, children and subtree sizes.

A tree is rows (sample_id, node_id, depth) in preorder by node_id. All of a sample is in one partition, so the windows below, over a
sample, its levels or its siblings, share one shuffle; each is a sort and a pass, linear in the nodes whatever the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes, about, that a task sorts and passes over; more only where one tree has more.
NODES_A_TASK = 200_000


def _rest(df: DataFrame) -> Column:
    """All columns but sample_id, which stays beside, so that Spark knows that the partitioning by it still holds."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "sample_id"))


def subtree_sizes(tree: DataFrame, name: str = "size", last: str | None = None) -> DataFrame:
    """tree with the number of nodes under each, itself included: up to the next node that isn't deeper, or the end. A node closes
    those open at its own depth and deeper; as each node is closed once, there are as many closings as nodes, and the first closing
    of its level that follows a node is its end. A tree may be cut off at any node, and ids may have gaps. last names a column: of
    each subtree's last node its value is returned as last_ and that name."""
    by = Window.partitionBy("sample_id").orderBy("node_id")
    value = F.col(last) if last else F.lit(None).cast("int")
    t = tree.select("sample_id", F.col("depth").alias("_d"), F.row_number().over(by).alias("_at"), F.lag("depth").over(by).alias("_before"), F.lead("depth").over(by).isNull().alias("_last"), value.alias("_v"), F.lag(value).over(by).alias("_p"), _rest(tree).alias("_row"))
    none = F.lit(None).cast(t.schema["_row"].dataType)
    event = lambda level, at, kind, row, v: F.struct(level.cast("int").alias("level"), at.alias("at"), F.lit(kind).alias("kind"), row.alias("row"), v.alias("v"))
    closings = lambda lo, hi, at, v: F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda e: event(e, at, 0, none, v)))
    empty = F.slice(F.array(event(F.col("_d"), F.col("_at"), 0, none, F.col("_p"))), 1, 0)
    own = F.coalesce(closings(F.col("_d"), F.col("_before"), F.col("_at"), F.col("_p")), empty)
    final = F.when(F.col("_last"), closings(F.least(F.lit(0), F.col("_d")), F.col("_d"), F.col("_at") + 1, F.col("_v"))).otherwise(empty)
    events = t.select("sample_id", F.explode(F.concat(F.array(event(F.col("_d"), F.col("_at"), 1, F.col("_row"), F.col("_v"))), own, final)).alias("e")).select("sample_id", "e.*")
    level = Window.partitionBy("sample_id", "level").orderBy("at", "kind")
    ended = events.withColumn("end", F.lead("at").over(level)).withColumn("v", F.lead("v").over(level)).where("kind = 1")
    return ended.select("sample_id", "row.*", (F.col("end") - F.col("at")).cast("int").alias(name), *([F.col("v").alias(f"last_{last}")] if last else []))


def with_parents(tree: DataFrame) -> DataFrame:
    """tree with parent_id (-1: none), child_pos and child_count. A node's parent is the last one before it that is one less deep; its
    first child, if any, is the node that follows."""
    order = Window.partitionBy("sample_id").orderBy("node_id")
    tree = tree.withColumn("_inner", F.coalesce(F.lead("depth").over(order) > F.col("depth"), F.lit(False)))  # first, so that rows are dealt by sample
    kind, id_ = tree.select(_rest(tree).alias("r")).schema["r"].dataType, tree.schema["node_id"].dataType
    up = F.struct((F.col("depth") + 1).alias("level"), F.col("node_id").alias("up"), F.lit(None).cast(kind).alias("row"))
    own = F.struct(F.col("depth").alias("level"), F.lit(None).cast(id_).alias("up"), _rest(tree).alias("row"))
    by = Window.partitionBy("sample_id", "level").orderBy("_n")
    marked = tree.select("sample_id", F.col("node_id").alias("_n"), F.explode(F.array(own, up)).alias("x")).select("sample_id", "_n", "x.*")
    placed = marked.withColumn("parent_id", F.coalesce(F.last("up", ignorenulls=True).over(by), F.lit(-1))).where("row IS NOT NULL").select("sample_id", "row.*", "parent_id")
    siblings = Window.partitionBy("sample_id", "parent_id")
    numbered = placed.withColumn("child_pos", F.row_number().over(siblings.orderBy("node_id")) - 1).withColumn("_k", F.count("*").over(siblings).cast("int"))
    return numbered.withColumn("child_count", F.when(F.col("_inner"), F.lead("_k").over(order)).otherwise(0)).drop("_k", "_inner")


def with_parent(tree: DataFrame, **columns: str) -> DataFrame:
    """tree (with parent_id) and, by name, columns of each node's parent, null where it isn't in the table. Every node stands twice, as
    itself and as a parent, and meets its parent in a window, so the tree is computed once and rows dealt by sample stay."""
    kind = tree.select(_rest(tree).alias("r")).schema["r"].dataType
    up = F.struct(*(F.col(f"`{c}`").alias(name) for name, c in columns.items()))
    none = F.lit(None).cast(tree.select(up.alias("u")).schema["u"].dataType)
    own = F.struct(F.col("parent_id").alias("key"), F.lit(1).alias("kind"), _rest(tree).alias("row"), none.alias("up"))
    parent = F.struct(F.col("node_id").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("row"), up.alias("up"))
    both = tree.select("sample_id", F.explode(F.array(own, parent)).alias("x")).select("sample_id", "x.*")
    met = both.withColumn("up", F.first("up", ignorenulls=True).over(Window.partitionBy("sample_id", "key").orderBy("kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    return met.select(*(F.col("sample_id") if c == "sample_id" else F.col(f"row.`{c}`") for c in tree.columns), *(F.col(f"up.`{name}`") for name in columns))


def breadth_first(tree: DataFrame) -> DataFrame:
    """tree (with parent_id) renumbered level by level, in order of place within a level."""
    by = Window.partitionBy("sample_id").orderBy("depth", "node_id")
    new = tree.withColumn("_new", (F.row_number().over(by) - 1).cast("int"))
    up = new.select("sample_id", F.col("node_id").alias("parent_id"), F.col("_new").alias("_up"))
    return new.join(up, ["sample_id", "parent_id"], "left").withColumns({"node_id": F.col("_new"), "parent_id": F.coalesce("_up", F.lit(-1))}).select(*tree.columns)
