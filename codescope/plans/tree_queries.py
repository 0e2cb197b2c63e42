"""Queries over node features and selections on trees derived from lineitem: a supplier's lines in order are the nodes of one tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, node_features, preorder
from .code_queries import shipments
from .queries import query, rounded, table

MOST = 100

_TREE = """q AS (SELECT l_suppkey AS sample_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus) - 1 AS node_id, l_quantity::INTEGER % 12 + 1 AS q, l_returnflag AS type, l_linestatus = 'O' AS is_named FROM lineitem),
d AS (SELECT sample_id, node_id, type, is_named, CASE WHEN node_id = 0 THEN 0 ELSE node_id + min(CASE WHEN node_id = 0 THEN 0 ELSE q - node_id END) OVER (PARTITION BY sample_id ORDER BY node_id) END AS depth FROM q),
z AS (SELECT sample_id, count(*) AS whole, greatest(max(depth), 1) AS deepest FROM d GROUP BY sample_id),
j AS (SELECT a.sample_id, a.node_id, min(CASE WHEN b.node_id > a.node_id AND b.depth <= a.depth THEN b.node_id END) AS stop, max(CASE WHEN b.node_id < a.node_id AND b.depth = a.depth - 1 THEN b.node_id END) AS up FROM d a JOIN d b USING (sample_id) GROUP BY ALL),
p AS (SELECT d.*, coalesce(up, -1) AS parent_id, coalesce(stop, whole) - d.node_id AS size, whole, deepest FROM d JOIN j USING (sample_id, node_id) JOIN z USING (sample_id)),
k AS (SELECT sample_id, parent_id AS node_id, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT p.*, row_number() OVER (PARTITION BY p.sample_id, p.parent_id ORDER BY p.node_id) - 1 AS child_pos, coalesce(n, 0) AS child_count FROM p LEFT JOIN k USING (sample_id, node_id)),
m AS (SELECT sample_id, greatest(max(child_count), 1) AS widest FROM t GROUP BY sample_id),
a AS (SELECT t.*, widest, u.size AS above, u.child_count AS siblings FROM t JOIN m USING (sample_id) LEFT JOIN t u ON u.sample_id = t.sample_id AND u.node_id = t.parent_id)"""


def trees(spark, sf) -> DataFrame:
    """shipments() with parents, places, sizes, a type and a named flag."""
    s = shipments(spark, sf, "l_returnflag", "l_linestatus").select("sample_id", "node_id", "depth", F.col("l_returnflag").alias("type"), (F.col("l_linestatus") == "O").alias("is_named"))
    return preorder.subtree_sizes(preorder.with_parents(s))


@query(f"WITH {_TREE} SELECT sample_id, node_id, round(least(1.0, depth / 100.0), 9) AS f_depth, round(least(1.0, child_pos / 50.0), 9) AS f_child_pos, round(least(1.0, child_count / 50.0), 9) AS f_child_count, is_named::INTEGER::DOUBLE AS f_named, round(least(1.0, size / 512.0), 9) AS f_size, round(coalesce(size / above, 1.0), 9) AS f_parent_share FROM a")
def node_features_static(spark, sf):
    return rounded(graph.structural_features(trees(spark, sf)), 9)


@query(f"WITH {_TREE}, v AS (SELECT type, row_number() OVER (ORDER BY count(*) DESC, type) AS id, count(*) OVER () AS types FROM t GROUP BY type) SELECT sample_id, node_id, round(id / types, 9) AS f_type, round(depth / deepest, 9) AS f_depth, round(child_count / widest, 9) AS f_children, (child_count = 0)::INTEGER::DOUBLE AS f_leaf, is_named::INTEGER::DOUBLE AS f_named FROM a JOIN v USING (type)")
def node_features_type_share(spark, sf):
    types = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("type"))  # of all nodes, as each line is one
    return rounded(node_features.type_share_features(trees(spark, sf), graph.vocabulary(types)), 9)


@query(f"WITH {_TREE} SELECT sample_id, node_id, round(depth / deepest, 9) AS f_depth, round(child_count / widest, 9) AS f_children, (child_count = 0)::INTEGER::DOUBLE AS f_leaf, is_named::INTEGER::DOUBLE AS f_named, round(size / whole, 9) AS f_size, round(child_pos / greatest(coalesce(siblings, 1) - 1, 1), 9) AS f_place FROM a")
def node_features_relative(spark, sf):
    return rounded(node_features.relative_features(trees(spark, sf)), 9)


@query(f"WITH {_TREE} SELECT sample_id, node_id, depth::DOUBLE AS f_depth, child_pos::DOUBLE AS f_child_pos, child_count::DOUBLE AS f_child_count, is_named::INTEGER::DOUBLE AS f_named, size::DOUBLE AS f_size, round(coalesce(size / above, 1.0), 9) AS f_parent_share FROM a")
def node_features_raw(spark, sf):
    return rounded(node_features.raw_features(trees(spark, sf)), 9)


@query(
    f"""WITH RECURSIVE {_TREE}, w AS (SELECT sample_id, 0 AS step, [0::BIGINT] AS stack, 1 AS taken, -1::BIGINT AS seen FROM z
UNION ALL SELECT w.sample_id, step + 1, list_concat(stack[:-2], list_reverse(list_slice(coalesce(kids, []), greatest(1, len(coalesce(kids, [])) - ({MOST} - taken) + 1)::BIGINT, len(coalesce(kids, []))::BIGINT))), least({MOST}, taken + len(coalesce(kids, []))), stack[-1]
FROM w LEFT JOIN (SELECT sample_id, parent_id AS node_id, list(node_id ORDER BY child_pos) AS kids FROM t GROUP BY ALL) c ON c.sample_id = w.sample_id AND c.node_id = stack[-1] WHERE len(stack) > 0)
SELECT w.sample_id, (step - 1)::BIGINT AS node_id, child_pos, child_count, depth::BIGINT AS depth FROM w JOIN t ON t.sample_id = w.sample_id AND t.node_id = w.seen"""
)
def stack_limited(spark, sf):
    """The nodes that a stack with room for 100 lets a walk see; the SQL walks step by step."""
    return rounded(node_features.stack_limited(trees(spark, sf), MOST).select("sample_id", "node_id", "child_pos", "child_count", "depth"))
