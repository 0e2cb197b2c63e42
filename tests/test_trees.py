"""Trees of seven languages against a model with a stack, and what follows from preorder and depth against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codescope.operators import augment, graph, nesting, preorder

CODE = "ID long, code string, language string"
TOKENS = ["(", ")", "{", "}", "[", "]", ";", ";", "alpha", "b", "if", "else", "=", "12.5e-3", '"(q\\"{"', "'}'", "/* { ( */", "// )\n", "+=", "catch", ","]


def model(tokens):
    """(depth, inner, token) in preorder: containers on a stack, each knowing the last element in it and its open statement."""
    out = [(0, True, tokens[0])]
    stack = [{"depth": 0, "braces": True, "last": None, "statement": None}]
    for t in tokens:
        top = stack[-1]
        if t in ")]}" and len(stack) > 1:
            out.append((top["depth"] + 1, False, t))
            stack.pop()
            continue
        aside, depth = t[:2] in ("/*", "//"), top["depth"] + 1
        if top["braces"]:
            over = top["last"] is None or top["last"] == ";" or (top["last"] == "{}" and t not in nesting.GO_ON)
            if aside and top["last"] in (None, ";"):
                top["statement"] = None
            elif over and not aside:
                top["statement"] = True
                out.append((depth, True, t))
            depth += top["statement"] is not None
        if not aside:
            top["last"] = t + "}" if t == "{" else t
        if t in "([{":
            out += [(depth, True, t), (depth + 1, False, t)]
            stack.append({"depth": depth, "braces": t == "{", "last": None, "statement": None})
        else:
            out.append((depth, False, t))
    return out


@pytest.mark.parametrize("language", ["java", "cpp", "javascript", "c_sharp", "c"])
def test_random_nestings(spark, language):
    rng = random.Random(language)
    texts = [[rng.choice(TOKENS) for _ in range(rng.randint(1, 60))] for _ in range(40)] + [["("] * 300 + [")"] * 300, ["}"], ["{", "{"]]
    df = spark.createDataFrame([(k, rng.choice(["", "\n "]) + " ".join(t) + rng.choice(["", " \n"]), language) for k, t in enumerate(texts)], CODE)
    got = {}
    for r in graph.nodes(df).collect():
        got.setdefault(r["sample_id"], []).append(r)
    for k, t in enumerate(texts):
        rows = sorted(got[k], key=lambda r: r["node_id"])
        t = [x.strip() for x in t]
        assert [(r["depth"], r["child_count"] > 0, r["text"] if r["child_count"] == 0 else None) for r in rows] == [(d, i, None if i else x) for d, i, x in model(t)]
        assert all(r["text"].startswith(x[: nesting.TEXT]) for r, (_, i, x) in zip(rows, model(t), strict=True) if i and r["node_id"])
        by_brute_force(rows)


def by_brute_force(rows):
    for k, r in enumerate(rows):
        assert r["node_id"] == k
        up = next((j for j in range(k - 1, -1, -1) if rows[j]["depth"] < r["depth"]), -1)
        end = next((j for j in range(k + 1, len(rows)) if rows[j]["depth"] <= r["depth"]), len(rows))
        assert (r["parent_id"], r["size"]) == (up, end - k)
        assert r["child_count"] == sum(x["parent_id"] == k for x in rows)
        assert r["child_pos"] == sum(x["parent_id"] == up for x in rows[:k])


def tree_of(spark, code, language):
    return graph.nodes(spark.createDataFrame([(1, code, language)], CODE)).orderBy("node_id").collect()


@pytest.mark.parametrize(("language", "code", "inner", "leaves"), [
    ("c", "#define A(x) \\\n  {x\nint f(int a) { return a[1]; }", ["program", "function_definition", "argument_list", "block", "return_statement", "subscript"], ["#define A(x) \\\n  {x", "int", "f", "(", "int", "a", ")", "{", "return", "a", "[", "1", "]", ";", "}"]),
    ("cpp", 'auto s = R"x({"))x"; // }', ["program", "assignment"], ["auto", "s", "=", 'R"x({"))x"', ";", "// }"]),
    ("c_sharp", 'using A;\nvar p = @"c:\\"; class B { }', ["program", "import_declaration", "assignment", "class_declaration", "block"], ["using", "A", ";", "var", "p", "=", '@"c:\\"', ";", "class", "B", "{", "}"]),
    ("java", 'String t = """\n {"\n"""; do { x(); } while (y);', ["program", "assignment", "do_statement", "block", "call_statement", "argument_list", "condition"], ["String", "t", "=", '"""\n {"\n"""', ";", "do", "{", "x", "(", ")", ";", "}", "while", "(", "y", ")", ";"]),
    ("javascript", "let f = (a) => { g(`{${a}`) }", ["program", "assignment", "parenthesized", "block", "call_statement", "argument_list"], ["let", "f", "=", "(", "a", ")", "=>", "{", "g", "(", "`{${a}`", ")", "}"]),
    ("go", "package a\nx := `\"{`\nif x { b() }\n", ["program", "package_declaration", "assignment", "if_statement", "block", "call_statement", "argument_list"], ["package", "a", "x", ":=", '`"{`', "if", "x", "{", "b", "(", ")", "}"]),
    ("php", "<p>{<?php $a = <<<E\n{ \nE; # (\nf($a) ?>)", ["program", "assignment", "call_statement", "argument_list"], ["<p>{<?php", "$a", "=", "<<<E\n{ \nE", ";", "# (", "f", "(", "$a", ")", "?>)"]),
])
def test_languages(spark, language, code, inner, leaves):
    rows = tree_of(spark, code, language)
    assert [r["type"] for r in rows if r["child_count"]] == inner
    assert [r["text"] for r in rows if not r["child_count"]] == leaves
    raw = code.encode()
    assert all(raw[r["start"] :].startswith(r["text"].encode()) for r in rows)
    assert [r["text"] for r in rows][0] == code.rstrip()


def test_texts_of_inner_nodes(spark):
    rows = tree_of(spark, "é(a, \"é\") ; " + "f(" + "x," * 300 + "y);", "java")
    assert [(r["type"], r["text"]) for r in rows if r["child_count"]][1:4] == [("call_statement", 'é(a, "é") ;'), ("argument_list", '(a, "é")'), ("call_statement", ("f(" + "x," * 300)[:200])]


def test_odd_texts(spark):
    long = 'x = "' + '\\"' * 100_000 + '"; /*' + "(" * 100_000 + "*/ y"
    df = spark.createDataFrame([(1, None, "java"), (2, " \n", "java"), (3, "x", None), (4, "x", "rust"), (5, long, "java"), (6, "<b>x</b>", "html"), (7, "x = 1", "python"), (8, '"open', "go"), (9, "x", "sql")], CODE)
    got = {r["sample_id"]: r["n"] for r in graph.nodes(df).groupBy("sample_id").agg(F.count("*").alias("n")).collect()}
    assert got.keys() == {5, 6, 7, 8} and got[5] == 9
    assert {r["sample_id"] for r in graph.nodes(df, fallback="python").select("sample_id").distinct().collect()} == {3, 4, 5, 6, 7, 8, 9}
    assert graph.nodes(df.limit(0)).collect() == []


def test_breadth_first(spark):
    df = spark.createDataFrame([(1, "a(b); { c[d]; }", "java")], CODE)
    deep, level = graph.nodes(df).collect(), graph.nodes(df, order="bfs").orderBy("node_id").collect()
    assert [r["depth"] for r in level] == sorted(r["depth"] for r in deep)
    assert sorted((r["type"], r["size"], r["child_pos"]) for r in deep) == sorted((r["type"], r["size"], r["child_pos"]) for r in level)
    assert all(level[r["parent_id"]]["depth"] == r["depth"] - 1 for r in level[1:])
    assert [r["node_id"] for r in graph.nodes(df, order="bfs", max_nodes=5).orderBy("node_id").collect()] == list(range(5))


def test_code_graphs(spark):
    tree = graph.nodes(spark.createDataFrame([(1, "int f(int a) { return a; }", "c")], CODE)).cache()
    kinds = {r["edge_type"]: r["count"] for r in graph.edges(tree).groupBy("edge_type").count().collect()}
    n, leaves = tree.count(), tree.where("child_count = 0").count()
    assert kinds[0] == kinds[1] == n - 1 and kinds[3] == 2 * (leaves - 1)


# ---- from preorder and depth alone ----


def random_depths(rng, n):
    d, out = 0, []
    for _ in range(n):
        out.append(d)
        d = rng.randint(1, d + 1)
    return out


def test_sizes_and_parents(spark):
    """Truncated trees, gaps between ids and rows in any order."""
    rng = random.Random(4)
    trees = {k: random_depths(rng, rng.randint(1, 80)) for k in range(30)}
    rows = [(k, 3 * i + 5, d, f"r{i}") for k, ds in trees.items() for i, d in enumerate(ds)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sample_id long, node_id int, depth int, note string").repartition(5)
    got = {(r["sample_id"], (r["node_id"] - 5) // 3): r for r in preorder.subtree_sizes(preorder.with_parents(df)).collect()}
    assert len(got) == len(rows)
    for k, ds in trees.items():
        for i, d in enumerate(ds):
            r, end = got[k, i], next((j for j in range(i + 1, len(ds)) if ds[j] <= d), len(ds))
            up = next((j for j in range(i - 1, -1, -1) if ds[j] < d), None)
            kids = [j for j in range(i + 1, end) if ds[j] == d + 1]
            assert (r["note"], r["size"], r["parent_id"], r["child_count"]) == (f"r{i}", end - i, -1 if up is None else 3 * up + 5, len(kids))


def test_chain_of_100000(spark):
    chain = spark.range(100_000).select(F.lit(1).cast("long").alias("sample_id"), F.col("id").cast("int").alias("node_id"), F.col("id").cast("int").alias("depth"))
    got = preorder.subtree_sizes(preorder.with_parents(chain))
    assert got.where("size <> 100000 - node_id OR parent_id <> node_id - 1").count() == 0 and got.count() == 100_000


def test_one_shuffle(spark):
    """Texts, or rows of trees, are dealt once, and texts are cut once."""
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(preorder.subtree_sizes(preorder.with_parents(spark.createDataFrame([(1, 0, 0)], "sample_id long, node_id int, depth int")))) == 1
    assert shuffles(nesting.nodes(spark.createDataFrame([(1, "x", "c")], CODE))) == 1


# ---- renaming ----


@pytest.mark.parametrize(("language", "code", "after"), [
    ("java", 'int total = sum(total, x); // total\nString s = "total"; ', 'int var_2 = var_1(var_2, x); // total\nvar_0 s = "total"; '),
    ("php", "<?php $this->name = $name . 'name' ?>", "<?php $this->var_0 = $var_0 . 'name' ?>"),
    ("go", "\tfmt.Println(`fmt`, main)\n", "\tvar_1.var_0(`fmt`, main)\n"),
    ("c", "#define total 1\nbig_total = total;", "#define total 1\nvar_0 = var_1;"),
    ("rust", "total = 1", "total = 1"), ("java", "", ""), ("java", None, None), ("java", " \n", " \n"),
])
def test_renamed(spark, language, code, after):
    df = spark.createDataFrame([(1, code, language)], CODE)
    assert df.select(nesting.renamed(F.col("code"), F.col("language"), sorted(augment.KEPT_NAMES))).first()[0] == after


def test_renamed_text_nests_alike(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(k, " ".join(rng.choice([*TOKENS, "beta", "gamma_2", "this"]) for _ in range(50)), rng.choice(["java", "c", "php", "go"])) for k in range(40)], CODE)
    shape = ["sample_id", "node_id", "parent_id", "type", "size"]
    changed = df.withColumn("code", nesting.renamed(F.col("code"), F.col("language"), sorted(augment.KEPT_NAMES)))
    assert sorted(graph.nodes(changed).select(shape).collect()) == sorted(graph.nodes(df).select(shape).collect())
    assert changed.where("code LIKE '%var_0%' AND code NOT LIKE '%gamma_2%'").count() > 30


def test_augmented_by_language(spark):
    df = spark.createDataFrame([(k, "int alpha = beta(alpha);", "java") for k in range(60)], CODE)
    got = {r["code"] for r in augment.augmented(df, language="language").collect()}
    assert any("int var_0 = var_1(var_0);" in c for c in got) and all("alpha" in c or "var_0" in c for c in got)


def test_tasks_hold_no_more_of_larger_tables(spark, monkeypatch, tmp_path):
    """Trees, texts and graphs are dealt over more partitions where there are more of them, and a parent's columns need no join."""
    from codescope.operators import message_passing, node_features
    from codescope.plans.code_queries import shipments

    monkeypatch.setattr(preorder, "NODES_A_TASK", 50)
    monkeypatch.setattr(nesting, "CODE_A_TASK", 200)
    lines = [(s, o, 1, float(o % 9), "A", "O") for s in range(40) for o in range(10)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = preorder.subtree_sizes(preorder.with_parents(shipments(spark, str(tmp_path), "l_returnflag")))
    assert t.rdd.getNumPartitions() == 8 and t.count() == 400
    raw = node_features.raw_features(t.withColumn("is_named", F.lit(True)))
    assert raw.rdd.getNumPartitions() == 8
    size = {(r["sample_id"], r["node_id"]): r["size"] for r in t.collect()}
    up = {(r["sample_id"], r["node_id"]): r["parent_id"] for r in t.collect()}
    for r in raw.collect():
        at = (r["sample_id"], r["node_id"])
        assert r["f_parent_share"] == (size[at] / size[at[0], up[at]] if up[at] >= 0 else 1.0)
    p = spark.createDataFrame([(i, "c", f"int f() {{ return {i}; }}" * 2) for i in range(20)], "ID long, language string, code string")
    assert nesting.lexed(p).rdd.getNumPartitions() == -(-sum(len(r["code"]) for r in p.collect()) // 200)
    tree = graph.nodes(p).cache()
    graphs = graph.assembled(graph.encoded(tree, graph.vocabulary(tree)), graph.edges(tree))
    assert message_passing.graph_vectors(graphs).count() == 20
    assert graphs.select("sample_id").rdd.getNumPartitions() == -(-tree.count() // 50)
