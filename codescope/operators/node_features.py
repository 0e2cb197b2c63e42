"""Sets of node features beside graph.structural_features, and the selection of nodes by a stack of limited room.

tree is a table of graph.nodes() or of preorder's operators: sample_id, node_id (preorder), parent_id, child_pos, depth, child_count
and what a set needs beside them. Windows are over samples or over siblings, so all rows of a sample share one shuffle. A table
without rows gives none; a node whose parent isn't in the table counts as a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .preorder import with_parent


def _sample():
    return Window.partitionBy("sample_id")


def _relative(c: str) -> Column:
    """c by its largest in the sample; by 1 where all are 0."""
    return F.col(c) / F.greatest(F.max(c).over(_sample()), F.lit(1))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def type_share_features(tree: DataFrame, vocab: DataFrame) -> DataFrame:
    """Five features: the type's number (0: not in vocab) by the number of types, depth and children relative to the sample's largest,
    leaf and named flags. vocab is a row a type, as graph.vocabulary() makes it."""
    from .graph import encoded

    types = vocab.agg(F.greatest(F.count("*"), F.lit(1)).alias("_types"))  # one row
    t = encoded(tree, vocab).crossJoin(F.broadcast(types))
    return t.select(
        "sample_id", "node_id", (F.col("type_id") / F.col("_types")).alias("f_type"), _relative("depth").alias("f_depth"), _relative("child_count").alias("f_children"),
        _flag(F.col("child_count") == 0).alias("f_leaf"), _flag(F.col("is_named")).alias("f_named"),
    )


def relative_features(tree: DataFrame) -> DataFrame:
    """Six features relative to the sample: depth, children, leaf and named flags, subtree size by the root's, and the place among the
    siblings by the last place (0 for an only child). tree has size, of the whole tree also where nodes were cut off."""
    t = with_parent(tree, _siblings="child_count")
    last = F.greatest(F.coalesce(F.col("_siblings"), F.lit(1)) - 1, F.lit(1))
    whole = F.max(F.when(F.col("parent_id") < 0, F.col("size"))).over(_sample())
    return t.select(
        "sample_id", "node_id", _relative("depth").alias("f_depth"), _relative("child_count").alias("f_children"), _flag(F.col("child_count") == 0).alias("f_leaf"), _flag(F.col("is_named")).alias("f_named"),
        (F.col("size") / F.coalesce(whole, F.count("*").over(_sample()))).alias("f_size"), (F.col("child_pos") / last).alias("f_place"),
    )


def raw_features(tree: DataFrame) -> DataFrame:
    """Six features without bounds: depth, place, children, named flag, subtree size, and that by the parent's (1 for a root)."""
    t = with_parent(tree, _above="size")
    number = lambda c: F.col(c).cast("double").alias(f"f_{c}")
    return t.select("sample_id", "node_id", number("depth"), number("child_pos"), number("child_count"), _flag(F.col("is_named")).alias("f_named"), number("size"), F.coalesce(F.col("size") / F.col("_above"), F.lit(1.0)).alias("f_parent_share"))


def stack_limited(tree: DataFrame, most: int) -> DataFrame:
    """The nodes that a walk in preorder sees whose stack takes a child only while seen and waiting nodes together are fewer than most,
    rightmost children first, so a node without room for all keeps its last ones. Nodes are numbered anew in preorder;
    child_count and child_pos stay those of the whole tree.

    Seen and waiting nodes are all that were ever taken, so before a node that many are 1 and the children of all nodes before it in
    preorder: a running sum. Room is left for all children up to one node, for the last few at that one, and for none after it, so
    every node's fate follows from its parent's sum, and there is no walk."""
    if most < 1:
        return tree.limit(0)
    order = _sample().orderBy("node_id")
    before = F.coalesce(F.sum("child_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    t = with_parent(tree.withColumn("_taken", before), _room="_taken", _all="child_count")
    first = F.col("_all") - (most - F.col("_room"))  # the first child that there's room for
    kept = t.where(F.col("_room").isNull() | ((F.col("_room") < most) & (F.col("child_pos") >= first)))
    kept = kept.withColumn("_new", (F.row_number().over(order) - 1).cast("int"))
    new = with_parent(kept, _up="_new").withColumns({"node_id": F.col("_new"), "parent_id": F.coalesce("_up", F.lit(-1))})
    return new.select(*tree.columns)
