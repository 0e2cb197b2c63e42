"""Node features, the selection by a stack, the two-branch head, weights and reports, sources without a test so far."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from codescope.operators import graph, metrics, node_features, preorder, profile, two_branch
from codescope.sources import io

COLUMNS = "sample_id long, node_id int, parent_id int, child_pos int, child_count int, depth int, size int, type string, is_named boolean"


def made(parents, sample=1):
    """Rows of COLUMNS of a tree given by each node's parent, in preorder."""
    kids = {k: [j for j, p in enumerate(parents) if p == k] for k in range(-1, len(parents))}
    size = lambda k: 1 + sum(map(size, kids[k]))
    deep = lambda k: 0 if parents[k] < 0 else 1 + deep(parents[k])
    return [(sample, k, p, kids[p].index(k), len(kids[k]), deep(k), size(k), "ab"[k % 2], k % 3 == 0) for k, p in enumerate(parents)]


def grown(rng, n):
    """Parents in preorder: a node hangs on the node before it or on one above that."""
    out, path = [-1], [0]
    for k in range(1, n):
        del path[rng.randint(1, len(path)) :]
        out.append(path[-1])
        path.append(k)
    return out


def walked(parents, most):
    """What a walk takes, by recursion: a node takes its last children that there's room for, then each of them walks."""
    taken, seen = [1], []

    def visit(k):
        seen.append(k)
        kids = [j for j, p in enumerate(parents) if p == k]
        room = most - taken[0]
        own = kids[max(0, len(kids) - room) :] if room > 0 else []
        taken[0] += len(own)
        for j in own:
            visit(j)

    visit(0)
    return seen


def test_stack_limited_against_a_walk(spark):
    rng = random.Random(7)
    for most in (1, 2, 5, 9, 40):
        trees = [grown(rng, rng.randint(1, 30)) for _ in range(12)]
        df = spark.createDataFrame([r for s, t in enumerate(trees) for r in made(t, s)], COLUMNS)
        got = {}
        for r in node_features.stack_limited(df.withColumn("old", F.col("node_id")), most).collect():
            got.setdefault(r["sample_id"], []).append((r["node_id"], r["old"], r["parent_id"]))
        for s, t in enumerate(trees):
            rows = sorted(got[s])
            want = walked(t, most)
            assert [old for _, old, _ in rows] == want and [new for new, *_ in rows] == list(range(len(want)))
            assert all(up == (want.index(t[old]) if t[old] >= 0 else -1) for _, old, up in rows)
    assert node_features.stack_limited(df, 0).count() == 0
    assert node_features.stack_limited(df.limit(0), 5).count() == 0


def test_stack_limited_keeps_last_children(spark):
    star = spark.createDataFrame(made([-1, 0, 0, 0, 0]), COLUMNS)
    assert sorted(r["child_pos"] for r in node_features.stack_limited(star, 3).where("parent_id = 0").collect()) == [2, 3]


def test_feature_sets_by_hand(spark):
    # 0 has the children 1 and 3; 1 has the child 2
    tree = spark.createDataFrame(made([-1, 0, 1, 0]), COLUMNS)
    rel = {r["node_id"]: tuple(r)[2:] for r in node_features.relative_features(tree).collect()}
    assert rel == {0: (0.0, 1.0, 0.0, 1.0, 1.0, 0.0), 1: (0.5, 0.5, 0.0, 0.0, 0.5, 0.0), 2: (1.0, 0.0, 1.0, 0.0, 0.25, 0.0), 3: (0.5, 0.0, 1.0, 1.0, 0.25, 1.0)}
    raw = {r["node_id"]: tuple(r)[2:] for r in node_features.raw_features(tree).collect()}
    assert raw == {0: (0, 0, 2, 1, 4, 1), 1: (1, 0, 1, 0, 2, 0.5), 2: (2, 0, 0, 0, 1, 0.5), 3: (1, 1, 0, 1, 1, 0.25)}
    share = {r["node_id"]: tuple(r)[2:] for r in node_features.type_share_features(tree, graph.vocabulary(tree.where("type = 'b'"))).collect()}
    assert share == {0: (0.0, 0.0, 1.0, 0.0, 1.0), 1: (1.0, 0.5, 0.5, 0.0, 0.0), 2: (0.0, 1.0, 0.0, 1.0, 0.0), 3: (1.0, 0.5, 0.0, 1.0, 1.0)}
    alone = spark.createDataFrame(made([-1]), COLUMNS).withColumn("is_named", F.lit(None).cast("boolean"))
    assert tuple(node_features.relative_features(alone).first())[2:] == (0, 0, 1, 0, 1, 0)
    assert node_features.relative_features(tree.limit(0)).count() == node_features.raw_features(tree.limit(0)).count() == 0


def test_features_of_a_cut_tree_use_the_whole_size(spark):
    tree = spark.createDataFrame(made([-1, 0, 1, 0]), COLUMNS).where("node_id < 2")
    assert [r["f_size"] for r in node_features.relative_features(tree).orderBy("node_id").collect()] == [1.0, 0.5]


def test_bfs_and_fallback(spark):
    df = spark.createDataFrame([(1, "x = [1]\ny = 2", "klingon"), (2, "if", "klingon"), (3, None, "klingon")], "ID long, code string, language string")
    assert graph.nodes(df).count() == 0
    tree = graph.nodes(df, fallback="python")
    assert {r["sample_id"] for r in tree.select("sample_id").distinct().collect()} == {1}
    wide = graph.nodes(df, fallback="python", order="bfs").orderBy("node_id").collect()
    assert [r["depth"] for r in wide] == sorted(r["depth"] for r in wide) and len(wide) == tree.count()
    kids = spark.createDataFrame([(5, "", "python"), (6, "a", "python")], "ID long, code string, language string")
    assert {r["sample_id"] for r in graph.with_children_only(graph.nodes(kids)).collect()} == {6}


def test_assembled(spark):
    tree = spark.createDataFrame(made([-1, 0, 1, 0]), COLUMNS).withColumn("start", F.col("node_id"))
    vocab = graph.sorted_vocabulary(tree)
    row = graph.assembled(graph.encoded(tree, vocab), graph.parent_edges(tree)).first()
    assert row["type_ids"] == [1, 2, 1, 2]
    assert [tuple(e) for e in row["edges"]] == [(0, 0, 1), (0, 0, 3), (0, 1, 2), (1, 1, 0), (1, 2, 1), (1, 3, 0)]


def test_edges_of_a_page(spark):
    """document 0, a 1, b 2, c 3: b and c are siblings and leaves that follow each other. A page without elements is a loop."""
    df = spark.createDataFrame([(1, "<a><b></b><c></c></a>"), (2, ""), (3, None), (4, " ")], "page_id long, html string")
    tree = io.materialised(graph.truncated(graph.nodes(df, "html", "page_id", F.lit("html"))))
    got = sorted(map(tuple, graph.edges(tree).select("sample_id", "src", "dst", "edge_type").collect()))
    both = lambda a, b, there, back: [(1, a, b, there), (1, b, a, back)]
    assert got == sorted(both(0, 1, 0, 1) + both(1, 2, 0, 1) + both(1, 3, 0, 1) + both(2, 3, 2, 2) + both(2, 3, 3, 3) + [(4, 0, 0, 0)])


def test_weights_of_absent_classes(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    # total / (K n) are 8/18 and 8/6, an absent class 1
    raw = [8 / 18, 8 / 6, 1.0]
    got = [r["weight"] for r in profile.class_weights(df, 3, "total_one").orderBy("label").collect()]
    assert got == pytest.approx([x * 3 / sum(raw) for x in raw])


def test_report_of_true_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "label int, prediction int")
    m = metrics.confusion(df)
    assert {r["label"] for r in metrics.report(m).collect()} == {0, 1, 2}
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in metrics.report(m, only_true=True).collect()}
    assert got == {0: (1.0, 0.5, 2), 1: (1.0, 1.0, 1)}


def test_subset(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ((1, 2, 2), (1, 2, 3)))
    assert profile.is_subset(a, b, "k") and not profile.is_subset(b, a, "k") and profile.is_subset(a.limit(0), b, "k")


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "c", None)], "id long, code string, label int")
    rows.write.parquet(f"{tmp_path}/b.parquet")
    got = io.labelled_test(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"]).collect()
    assert [(r["ID"], r["code"], r["label"], r["language"]) for r in got] == [(1, "a", 0, None)]
    with pytest.raises(FileNotFoundError):
        io.labelled_test(spark, [f"{tmp_path}/none.parquet"])
    rows.select("id", "code").write.parquet(f"{tmp_path}/c.parquet")
    with pytest.raises(ValueError):
        io.labelled_test(spark, [f"{tmp_path}/c.parquet"])
    io.write_json(rows, f"{tmp_path}/j")
    back = io.read_json(spark, f"{tmp_path}/j", rows.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    arrays = spark.createDataFrame([(1, [0.5, 1.5], 0), (2, [], 1), (3, None, 1)], "id long, v array<double>, part int")
    io.write_arrays(arrays, f"{tmp_path}/v", "part")
    assert sorted((r["id"], r["v"], r["part"]) for r in spark.read.parquet(f"{tmp_path}/v").collect() if r["v"] is not None) == [(1, [0.5, 1.5], 0), (2, [], 1)]
    assert {p.name for p in (tmp_path / "v").iterdir() if p.is_dir()} == {"part=0", "part=1"}


def test_read_several_files_as_one(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "ID long, code string").write.parquet(f"{tmp_path}/x1")
    spark.createDataFrame([(2, "b", "go")], "ID long, code string, language string").write.parquet(f"{tmp_path}/x2")
    got = io.read_parquet(spark, f"{tmp_path}/x1", f"{tmp_path}/x2").orderBy("ID").collect()
    assert [(r["ID"], r["code"], r["language"]) for r in got] == [(1, "a", None), (2, "b", "go")]
    assert io.read_parquet(spark, f"{tmp_path}/x*").count() == 2


def test_normalised_embedding():
    rows = pd.Series([[1.0, 3.0], [2.0, 2.0], None, [1.0], [float("nan"), 4.0]])
    assert two_branch.normalised(rows, 2).tolist() == [[-1.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [-1.0, 1.0]]


def test_two_branches(spark):
    """The label needs both inputs: whether the signs of the embedding's slope and of a feature agree in one of four classes."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        slope, x = rng.choice([-1, 1]), rng.normal()
        v = slope * np.arange(4) + rng.normal(0, 0.2, 4)
        rows.append((k, [float(a) for a in v], float(x), float(rng.normal()), int(2 * (slope > 0) + (x > 0))))
    rows += [(900, None, float("nan"), None, 0), (901, [1.0] * 4, math.inf, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, emb array<double>, x double, noise double, label int").withColumn("prediction", F.lit("old"))
    head = two_branch.fit(df, "emb", ["x", "noise"], 4, 4, branch=(8, 6), fusion=(8,), iterations=60)
    out = head.transform(df)
    assert out.count() == len(rows) and out.columns == ["id", "emb", "x", "noise", "label", "prediction", "probs"]
    whole = out.where("id < 600").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert whole > 0.9
    # the same by the fitted models: what Spark's own fusion model says of the activations of both branches
    d = io.materialised(two_branch.inputs(df, "emb", ["x", "noise"], 4, "id"))
    own = head.fusion.transform(two_branch.activations(d, head.embedded, head.crafted).withColumn("v", array_to_vector("hidden")))
    want = {int(r["label"]): r["probability"].toArray() for r in own.collect()}
    for r in out.collect():
        assert np.allclose(r["probs"], want[r["id"]]) and r["prediction"] == int(np.argmax(want[r["id"]]))
    # and a branch's own last layer on its activations gives its own output
    w, b = two_branch._layers(head.crafted)[-1]
    h = {r["label"]: np.array(r["hidden"])[-6:] for r in two_branch.activations(d, head.embedded, head.crafted).collect()}
    for r in head.crafted.transform(d.withColumn("v", array_to_vector("f"))).collect():
        assert np.allclose(h[r["label"]] @ w + b, r["rawPrediction"].toArray())
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    alone = head.crafted.transform(d.withColumnRenamed("label", "id").where("id < 600").join(df.select("id", "label"), "id").withColumn("v", array_to_vector("f")))
    assert alone.agg(right).first()[0] < 0.7 < whole


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 25))
def test_raw_features_follow_preorder(spark, seed, n):
    """Depth, places and sizes of the operators over (node_id, depth) are those of the tree that the depths came from."""
    rows = made(grown(random.Random(seed), n))
    df = spark.createDataFrame(rows, COLUMNS)
    bare = preorder.subtree_sizes(preorder.with_parents(df.select("sample_id", "node_id", "depth", "is_named")))
    assert sorted(map(tuple, node_features.raw_features(bare).collect())) == sorted(map(tuple, node_features.raw_features(df).collect()))
