"""Trees a text at a time against those of graph.nodes(), and what their queries take."""

import random

import numpy as np
from pyspark.sql import functions as F

from codescope.operators import graph, message_passing, nesting, packed
from codescope.plans import code_queries, model_queries

from test_trees import CODE, TOKENS

MORE = ["else if", "class", "return", "do", "while", "fallthrough", "++", ":=", ".", "->", "#", "# {\n", "#define {\n", "<?php", "?>", "<?=", "$", "$a", "é", "«", "٣", ".5", "<<<", "''", '"', "`{`", "\n", " ", "'''"]


def texts(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice(["", "\n ", " {"]) + rng.choice([" ", "\n", ""]).join(rng.choice(TOKENS + MORE) for _ in range(rng.randint(1, 90))), rng.choice(list(nesting.LANGUAGES))) for k in range(400)]
    odd = [None, "", " \n", ")", "]x", "/* a", "(" * 400 + ")" * 500, "{" * 60, "x;" * 700]
    rows += [(1000 + 10 * k + j, x, language) for k, x in enumerate(odd) for j, language in enumerate(["java", "go", "php"])]
    return spark.createDataFrame([*rows, (5000, "x = 1", "python"), (5001, "def f(:", "python"), (5002, "<b>x</b><i>", "html"), (5003, "x", None), (5004, "x", "rust")], CODE).repartition(3)


def by_text(tree):
    out = {}
    for r in tree.collect():
        out.setdefault(r["sample_id"], []).append(r)
    return {k: sorted(rows, key=lambda r: r["node_id"]) for k, rows in out.items()}


def test_packed_trees_are_those_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(packed, "TOKENS_AT_ONCE", 500)
    df = texts(spark)
    want, got = by_text(graph.nodes(df)), {r["sample_id"]: r for r in packed.packed(df).collect()}
    assert got.keys() == want.keys() and len(got) > 400
    for k, rows in want.items():
        assert got[k]["types"] == [r["type"] for r in rows] and got[k]["parents"] == [r["parent_id"] for r in rows], k


def test_sums_by_type(spark):
    df = texts(spark)
    t = graph.nodes(df).join(df.select(F.col("ID").alias("sample_id"), "language"), "sample_id")
    want = t.groupBy("language", "type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("depth").alias("depth"), F.sum("child_count").alias("children"))
    assert sorted(map(tuple, packed.type_sums(df).collect())) == sorted(map(tuple, want.collect()))
    assert packed.type_sums(df.limit(0)).collect() == []


def test_vectors_of_packed_trees(spark, monkeypatch):
    monkeypatch.setattr(message_passing, "NODES_AT_ONCE", 300)
    df = texts(spark).where("ID NOT BETWEEN 1060 AND 1079")
    tree = graph.nodes(df).cache()
    vocab = graph.vocabulary(tree)
    for kind in ("gcn", "gat"):
        want = {r["sample_id"]: r["vector"] for r in message_passing.graph_vectors(graph.assembled(graph.encoded(tree, vocab), graph.edges(tree)), 6, 2, kind).collect()}
        got = {r["sample_id"]: r["vector"] for r in message_passing.tree_vectors(packed.packed(df), vocab, 6, 2, kind).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def orders(spark, path, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{path}/orders.parquet")


def test_program_vectors_are_of_whole_programs(spark, tmp_path):
    """Programs that are alike in their first 1,000 nodes and differ in the last statement."""
    alike = [(4 * k + 2, c, "O", "1-URGENT") for k in range(100) for c in (7, 14)]
    orders(spark, tmp_path, [*alike, (1001, 7, "O", "1-URGENT"), (1000, 14, "O", "1-URGENT")])
    got = {}
    for r in model_queries.program_vectors(spark, str(tmp_path)).collect():
        got.setdefault(r["sample_id"], {})[r["place"]] = r["x"]
    assert got.keys() == {7, 14} and got[7] != got[14]
    p = code_queries.programs(spark, str(tmp_path))
    tree = graph.nodes(p).cache()
    assert tree.count() > 2 * 1000
    want = message_passing.graph_vectors(graph.assembled(graph.encoded(tree, graph.vocabulary(tree)), graph.edges(tree))).collect()
    assert all(np.allclose([got[r["sample_id"]][k] for k in range(32)], r["vector"], atol=1e-6) for r in want)


def test_nodes_are_not_shuffled(spark, tmp_path):
    """Neither query sorts nodes: programs are put together in the one shuffle of orders, and only sums follow."""
    orders(spark, tmp_path, [(k, k % 5, "O", "1-URGENT") for k in range(50)])
    plan = code_queries.code_tree_types(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange ") == 2
    plan = model_queries.program_vectors(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange ") == 0
