"""Queries over trees of code in seven languages. The tables have no code, so programs are derived from them: a customer's orders are
the statements of one program, its key says in which language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import augment, nesting, packed, preorder
from ..sources.io import dealt
from .queries import query, rounded, table

#: language: what stands before and after the statements
SHELLS = {
    "c": ("#include <a.h>\nint spend(int total) { ", " return total; }\n"),
    "cpp": ("#include <a>\nint spend(int total) { ", " return total; }\n"),
    "c_sharp": ("using System;\nclass Customer { int Spend(int total) { ", " return total; } }\n"),
    "java": ("import a.b;\nclass Customer { int spend(int total) { ", " return total; } }\n"),
    "javascript": ("function spend(total) { ", " return total; }\n"),
    "go": ("package main\nfunc spend(total int) int {\n", "\nreturn total\n}\n"),
    "php": ("<?php function spend($total) { ", " return $total; } ?>\n"),
}


def programs(spark, sf) -> DataFrame:
    """(ID, language, code): a program a customer that has orders."""
    k = F.col("o_orderkey").cast("string")
    forms = (
        F.concat(F.lit("total = total + "), k, F.lit(";")),
        F.concat(F.lit("if (order_"), k, F.lit(' > 3) { emit("}\\"( '), F.col("o_orderstatus"), F.lit('", ['), k, F.lit(", 2]); }")),
        F.concat(F.lit("for (i = 0; i < "), k, F.lit("; i++) { total += price[i]; } // closes }\n")),
        F.concat(F.lit("/* ( { "), F.col("o_orderpriority"), F.lit(" */ note('(');")),
    )
    which = F.col("o_orderkey") % 4
    stmt = F.when(which == 0, forms[0]).when(which == 1, forms[1]).when(which == 2, forms[2]).otherwise(forms[3])
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ID")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", stmt.alias("s")))).alias("ss"))
    body = F.array_join(F.transform("ss", lambda x: x["s"]), " ")
    names = F.array(*map(F.lit, SHELLS))
    part = lambda i: F.get(F.array(*(F.lit(x[i]) for x in SHELLS.values())), (F.col("ID") % 7).cast("int"))
    return by.select("ID", F.get(names, (F.col("ID") % 7).cast("int")).alias("language"), F.concat(part(0), body, part(1)).alias("code"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


_FORMS = """CASE o_orderkey % 4 WHEN 0 THEN 'total = total + ' || o_orderkey || ';' WHEN 1 THEN 'if (order_' || o_orderkey || ' > 3) { emit("}\\"( ' || o_orderstatus || '", [' || o_orderkey || ', 2]); }'
WHEN 2 THEN 'for (i = 0; i < ' || o_orderkey || '; i++) { total += price[i]; } // closes }' || chr(10) ELSE '/* ( { ' || o_orderpriority || ' */ note(''('');' END"""
#: The patterns as the other engine takes them: no possessive loops, and none of the forms that refer back, which no program has.
_PATTERNS = [nesting.pattern(x).replace("*+", "*").replace(nesting.LANGUAGES[x]["string"][0] + "|", "" if r"\1" in nesting.LANGUAGES[x]["string"][0] else nesting.LANGUAGES[x]["string"][0].replace("*+", "*") + "|") for x in SHELLS]
_PROGRAMS = f"""prog AS (SELECT o_custkey AS ID, o_custkey % 7 AS l, {_list(x[0] for x in SHELLS.values())}[1 + o_custkey % 7] || string_agg({_FORMS}, ' ' ORDER BY o_orderkey) || {_list(x[1] for x in SHELLS.values())}[1 + o_custkey % 7] AS code FROM orders GROUP BY o_custkey),
cut AS ({" UNION ALL ".join(f"SELECT ID, l, code, regexp_extract_all(code, {_quoted(p)}) AS raws FROM prog WHERE l = {k}" for k, p in enumerate(_PATTERNS))}),
tok AS (SELECT ID, l, unnest(range(len(raws))) AS pos, ltrim(unnest(raws), ' ' || chr(9) || chr(10)) AS tok FROM cut)"""


@query(
    f"""WITH {_PROGRAMS}, s AS (SELECT *, sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY ID ORDER BY pos) AS s FROM tok),
v AS (SELECT ID, pos, tok, CASE WHEN tok IN (')', ']', '}}') THEN s + 1 ELSE s END AS lv FROM s),
g AS (SELECT *, CASE WHEN lv = 0 THEN -1 ELSE max(CASE WHEN tok IN ('(', '[', '{{') THEN pos END) OVER (PARTITION BY ID, lv ORDER BY pos) END AS grp FROM v)
SELECT ID, count(*) AS n_tokens, count(*) FILTER (tok IN ('(', '[', '{{')) AS n_groups, max(lv)::BIGINT AS deepest, sum(pos * lv)::BIGINT AS levels, sum(grp)::BIGINT AS groups FROM g GROUP BY ID"""
)
def code_nesting(spark, sf):
    """Levels and groups of the tokens of every program."""
    rows = nesting.lexed(programs(spark, sf)).withColumn("kind", F.col("tok"))
    held = nesting.grouped(nesting.levels(rows)).where("leaf OR closes")
    return rounded(held.groupBy(F.col("sample_id").alias("ID")).agg(F.count("*").alias("n_tokens"), F.count_if("opens").alias("n_groups"), F.max("level").alias("deepest"), F.sum(F.col("pos") * F.col("level")).alias("levels"), F.sum("group").alias("groups")))


@query()
def code_tree_types(spark, sf):
    """Node types of the programs by language, with their sizes and depths."""
    return rounded(packed.type_sums(programs(spark, sf)))


_KEPT = "[" + ", ".join(_quoted(x) for x in sorted(augment.KEPT_NAMES) + nesting.KEYWORDS) + "]"


@query(
    f"""WITH {_PROGRAMS}, w AS (SELECT ID, l, pos, tok, CASE WHEN l = 6 THEN ltrim(tok, '$') ELSE tok END AS name FROM tok), y AS (SELECT *, regexp_matches(tok, '^[A-Za-z_$]') AND length(name) > 1 AND NOT list_contains({_KEPT}, name) AND NOT list_contains({_KEPT}, tok) AS yes FROM w),
m AS (SELECT ID, name, row_number() OVER (PARTITION BY ID ORDER BY name) - 1 AS k FROM (SELECT DISTINCT ID, name FROM y WHERE yes)),
r AS (SELECT ID, pos, CASE WHEN yes THEN tok[1:length(tok) - length(name)] || 'var_' || k ELSE tok END AS t FROM y LEFT JOIN m USING (ID, name))
SELECT ID, md5(string_agg(t, ' ' ORDER BY pos)) AS tokens_md5 FROM r GROUP BY ID"""
)
def code_renamed(spark, sf):
    """Every program with its identifiers renamed; of its tokens, white space left out."""
    p = programs(spark, sf)
    new = p.withColumn("code", nesting.renamed(F.col("code"), F.col("language"), sorted(augment.KEPT_NAMES)))
    cut = F.transform(nesting.tokens(F.col("code"), F.col("language")), lambda x: F.ltrim(x, F.lit(nesting.SPACE)))
    return new.select("ID", F.md5(F.array_join(cut, " ")).alias("tokens_md5"))


_DEPTHS = """q AS (SELECT l_suppkey AS sample_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS node_id, l_quantity::INTEGER % 12 + 1 AS q FROM lineitem),
d AS (SELECT sample_id, node_id, CASE WHEN node_id = 0 THEN 0 ELSE node_id + min(CASE WHEN node_id = 0 THEN 0 ELSE q - node_id END) OVER (PARTITION BY sample_id ORDER BY node_id) END AS depth FROM q)"""


def shipments(spark, sf, *more: str) -> DataFrame:
    """(sample_id, node_id, depth): a tree a supplier, whose nodes are its lines in order; a line is at most one deeper than the line
    before, and else as deep as its quantity says. more names columns of lineitem to keep, by which equal lines are ordered."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id"), "l_orderkey", "l_linenumber", "l_quantity", *more)
    by = Window.partitionBy("sample_id").orderBy("l_orderkey", "l_linenumber", "l_quantity", *more)
    l = dealt(lines, "sample_id", lines.count(), preorder.NODES_A_TASK).select("sample_id", (F.row_number().over(by) - 1).alias("node_id"), (F.col("l_quantity").cast("int") % 12 + 1).alias("q"), *more)
    least = F.min(F.when(F.col("node_id") == 0, 0).otherwise(F.col("q") - F.col("node_id"))).over(Window.partitionBy("sample_id").orderBy("node_id"))
    return l.select("sample_id", "node_id", F.when(F.col("node_id") == 0, 0).otherwise(F.col("node_id") + least).alias("depth"), *more)


@query(f"WITH {_DEPTHS}, e AS (SELECT a.sample_id, a.node_id, min(b.node_id) AS stop FROM d a JOIN d b ON a.sample_id = b.sample_id AND b.node_id > a.node_id AND b.depth <= a.depth GROUP BY ALL), n AS (SELECT sample_id, count(*) AS n FROM d GROUP BY sample_id) SELECT d.sample_id, d.node_id, d.depth::BIGINT AS depth, coalesce(stop, n) - d.node_id AS size FROM d JOIN n USING (sample_id) LEFT JOIN e USING (sample_id, node_id)")
def subtree_sizes(spark, sf):
    return rounded(preorder.subtree_sizes(shipments(spark, sf)))


@query(f"WITH {_DEPTHS}, u AS (SELECT a.sample_id, a.node_id, max(b.node_id) AS up FROM d a JOIN d b ON a.sample_id = b.sample_id AND b.node_id < a.node_id AND b.depth = a.depth - 1 GROUP BY ALL), p AS (SELECT d.sample_id, d.node_id, coalesce(up, -1) AS parent_id FROM d LEFT JOIN u USING (sample_id, node_id)), k AS (SELECT sample_id, parent_id AS node_id, count(*) AS n FROM p GROUP BY ALL) SELECT p.*, row_number() OVER (PARTITION BY p.sample_id, p.parent_id ORDER BY p.node_id) - 1 AS child_pos, coalesce(n, 0) AS child_count FROM p LEFT JOIN k USING (sample_id, node_id)")
def tree_parents(spark, sf):
    return rounded(preorder.with_parents(shipments(spark, sf)).drop("depth"))
