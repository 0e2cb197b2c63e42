"""Perplexity by windows, exact quantiles, boosting by stages, importances and message passing, against brute force."""

import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescope.operators import boosting, graph, message_passing, metrics, models, profile, quantiles, vectors


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


# ---- windows ----


def perplexity_plainly(text, loss, length, stride):
    t = re.findall(vectors.TOKEN, (text or "").lower())[: 4 * length]
    total, seen, begin = 0.0, 0, 0
    while t:
        end = min(begin + length, len(t))
        x = loss(t[begin:end], end - seen)
        if x is None:
            return math.inf
        total, seen = total + x * (end - seen), end
        if end == len(t):
            return math.exp(total / seen)
        begin += stride
    return math.inf


def test_windowed_perplexity(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c ( ) x1 7 the".split()) for _ in range(n)) for n in (1, 2, 7, 8, 9, 12, 13, 16, 17, 31, 32, 33, 40, 200)] + [None, "", " \n", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, code string")
    pairs, firsts = Counter(), Counter()
    for t in texts:
        w = ["<s>", *re.findall(vectors.TOKEN, (t or "").lower())]
        pairs.update(zip(w, w[1:], strict=False))
        firsts.update(w[:-1])
    v = len({b for _, b in pairs})

    def loss(w, target):
        ps = [-math.log((pairs[a, b] + 1) / (firsts[a] + v + 1)) for a, b in list(zip(w, w[1:], strict=False))[-target:]]
        return sum(ps) / len(ps) if ps else None

    got = {r["ID"]: r["perplexity"] for r in vectors.windowed_perplexity(df, vectors.bigram_losses(vectors.fit_bigram_lm(df)), length=8, stride=4).collect()}
    assert all(close(got[k], perplexity_plainly(t, loss, 8, 4)) for k, t in enumerate(texts)) and len(got) == len(texts)


def test_own_perplexity(spark):
    """The perplexity of texts by their own model is that of the fitted one, by whole texts and by windows; a text has one row a
    distinct pair and one a distinct context, however often they occur."""
    rng = random.Random(5)
    texts = ["a b " * 500, "a", None, "", " \n", "zz a", *(" ".join(rng.choice("a b c ( ) x1 7 the".split()) for _ in range(n)) for n in (2, 3, 7, 8, 9, 12, 13, 31, 32, 33, 40, 300))]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, code string")
    lm = vectors.fit_bigram_lm(df)
    for plain, own in ((vectors.perplexity(df, lm), vectors.own_perplexity(df)), (vectors.windowed_perplexity(df, vectors.bigram_losses(lm), length=8, stride=4), vectors.own_perplexity(df, length=8))):
        want, got = ({r["ID"]: r["perplexity"] for r in x.collect()} for x in (plain, own))
        assert got.keys() == want.keys() == set(range(len(texts))) and all(close(got[k], want[k]) for k in want)
    counts = vectors.own_counts(vectors.tokenised(df, hashed=True), "code", "ID").where("ID < 2").collect()
    assert sorted((r["ID"], r["c"], r["s"]) for r in counts) == [(0, -500, 500.0), (0, -499, 499.0), (0, -1, 1.0), (0, 1, 1.0), (0, 499, 499.0), (0, 500, 500.0), (1, -1, 1.0), (1, 1, 1.0)]
    empty = vectors.own_perplexity(df.where("ID < 0"))
    assert empty.count() == 0


def test_losses_of_a_model(spark):
    """A model from outside, and one that fails on some windows: those texts are infinite, the job goes on."""
    texts = ["a b c d e f g h i j k", "boom a b", "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, code string")

    def load():
        def run(windows):
            if any("boom" in t for t, _ in windows):
                raise RuntimeError
            return [len(t) / 10 + target for t, target in windows]

        return run

    got = {r["ID"]: r["perplexity"] for r in vectors.windowed_perplexity(df, vectors.model_losses(load, batch=1), length=8, stride=4).collect()}
    for k, t in enumerate(texts):
        assert close(got[k], perplexity_plainly(t, lambda w, n: None if "boom" in w else len(w) / 10 + n, 8, 4))


def test_perplexity_report(spark):
    rows = [(1.0, 1), (2.0, 1), (5.0, 0), (7.0, 0), (3.0, 0), (math.inf, 1), (math.nan, 0), (None, 1)]
    r = metrics.perplexity_report(spark.createDataFrame(rows, "s double, label int"), "s").first()
    assert (r["n_valid"], r["n_infinite"], r["mean_1"], r["median_0"], r["auc"]) == (5, 3, 1.5, 5.0, 0.0)
    assert r["threshold"] == 1.0 and r["accuracy"] == 0.6
    none = metrics.perplexity_report(spark.createDataFrame([(math.inf, 1)], "s double, label int"), "s").first()
    assert (none["threshold"], none["auc"], none["accuracy"], none["mean_0"], none["median_1"]) == (100.0, 0.5, 0.0, 0.0, 0.0)


# ---- quantiles ----


def test_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CELLS", 4)
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = random.Random(2)
    values = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [5.0] * 40 + [6.0], "c": [1.0], "d": [-1.7e308, 1.7e308, 0.0, 1e-300], "e": [rng.choice([1.0, 2.0, 1e6]) for _ in range(100)], None: [3.0, 4.0]}
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("a", None), ("a", math.nan), ("a", math.inf), ("none", math.nan)]
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", shares, "g").collect()}
    assert got.keys() == {(g, q) for g in values for q in shares}
    for (g, q), x in got.items():
        s = sorted(values[g])
        at = q * (len(s) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        assert close(x, lo if at == int(at) else lo * (1 - (at - int(at))) + hi * (at - int(at))), (g, q)
    assert quantiles.quantiles(spark.createDataFrame([], "g string, x double"), "x", [0.5]).collect() == []


def test_median_of_many_doubles(spark):
    """No buffer holds the values: 2,000,000 distinct ones, all but a few in a tiny range."""
    df = spark.range(2_000_000).select((F.xxhash64("id") / 1e30).alias("x")).union(spark.createDataFrame([(1e9,), (-1e9,)], "x double"))
    got = quantiles.quantiles(df, "x", [0.5]).first()["value"]
    assert close(got, df.agg(F.median("x")).first()[0])


def test_score_stats(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (9.0, 0), (math.inf, 1)], "s double, label int")
    got = {r["label"]: (r["n"], r["mean"], r["median"]) for r in profile.score_stats(df, "s", classes=3).collect()}
    assert got == {0: (3, 4.0, 2.0), 1: (0, 0.0, 0.0), 2: (0, 0.0, 0.0)}
    assert statistics.median([1.0, 2.0, 9.0]) == got[0][2]


# ---- boosting ----


@pytest.fixture(scope="module")
def flowers(spark):
    """Three classes by x alone, noise beside it."""
    rng = random.Random(6)
    rows = [(k, x := rng.uniform(0, 3), rng.gauss(0, 1), None if k % 50 == 0 else rng.uniform(0, 1), int(x) if rng.random() < 0.9 else rng.randrange(3)) for k in range(600)]
    return spark.createDataFrame(rows, "ID long, x double, noise double, other double, label int").na.fill(0.5).repartition(2).cache()


FEATURES = ["x", "noise", "other"]


@pytest.fixture(scope="module")
def grown(flowers):
    return boosting.boosted(flowers, FEATURES, 3, rounds=4, depth=3)


def test_stages_are_models_of_fewer_rounds(flowers, grown):
    short = boosting.boosted(flowers, FEATURES, 3, rounds=2, depth=3)
    assert short["rounds"] == grown["rounds"][:2]
    by = {r["stage"]: r for r in boosting.staged(flowers, grown).collect()}
    assert by.keys() == {1, 2, 3, 4}
    for n in (2, 4):
        whole = metrics.summary(metrics.confusion(boosting.predicted(flowers, {**grown, "rounds": grown["rounds"][:n]}))).first()
        assert close(by[n]["macro_f1"], whole["macro_f1"]) and close(by[n]["accuracy"], whole["accuracy"])
    assert by[4]["macro_f1"] > 0.85


def test_resuming(flowers, grown):
    begun = boosting.boosted(flowers, FEATURES, 3, rounds=3, depth=3)
    assert boosting.boosted(flowers, FEATURES, 3, rounds=4, depth=3, resume=boosting.load(boosting.save(begun)))["rounds"] == grown["rounds"]
    with pytest.raises(ValueError, match="settings"):
        boosting.boosted(flowers, FEATURES, 3, rounds=4, depth=2, resume=begun)


def test_stop_by_macro_f1(flowers):
    """Training ends patience rounds after the best one, and the model is cut to it."""
    train, val = flowers.where("ID % 3 > 0"), flowers.where("ID % 3 = 0")
    model = boosting.boosted(train, FEATURES, 3, rounds=6, depth=3, validation=val, patience=1)
    by = {r["stage"]: r["macro_f1"] for r in boosting.staged(val, model).collect()}
    assert all(close(by[k + 1], f) for k, f in enumerate(model["history"])) and len(by) == len(model["rounds"])
    assert max(by, key=lambda k: (by[k], -k)) == len(model["rounds"]) < 6


def test_permutation_importances(flowers, grown):
    got = {r["feature"]: r["importance"] for r in boosting.permutation_importances(lambda d: boosting.predicted(d, grown), flowers, FEATURES).collect()}
    assert got.keys() == set(FEATURES) and got["x"] > 0.3 and abs(got["noise"]) < 0.1 and abs(got["other"]) < 0.1


def test_importances_of_one_against_rest(flowers):
    """The models that have no importances of their own."""
    model = models.boosted_trees(flowers, FEATURES, classes=3, iterations=2, depth=3)
    got = {r["feature"]: r["importance"] for r in boosting.permutation_importances(lambda d: models.predicted(model, d), flowers, FEATURES).collect()}
    assert got["x"] > 0.3 > abs(got["noise"])


# ---- message passing ----


def vector_plainly(types, edges, dims, rounds, kind, jump, seed):
    """Node by node and edge by edge."""
    h = [np.random.default_rng((seed, t + 1)).normal(size=dims) for t in types]
    states = []
    for w in message_passing.layers(dims, rounds, seed):
        new = []
        for v in range(len(types)):
            x, own = h[v] @ w["own"], [e for e in edges if e[2] == v]
            if kind == "gcn":
                for t in range(5):
                    if near := [h[s] for k, s, _ in own if k == t]:
                        x = x + sum(near) / len(near) @ w["by"][t]
            elif own:
                moved = [h[s] @ w["by"][k] for k, s, _ in own]
                raw = [m @ w["from"] + h[v] @ w["own"] @ w["to"] for m in moved]
                e = [math.exp(r if r > 0 else 0.2 * r) for r in raw]
                x = x + sum(m * y for m, y in zip(moved, e, strict=True)) / sum(e)
            new.append(np.maximum(x, 0))
        h = new
        states.append(h)
    if jump:
        h = [np.max([s[v] for s in states], axis=0) for v in range(len(types))]
    q = np.random.default_rng((seed, 0)).normal(size=dims)
    e = [math.exp(x @ q) for x in h]
    return np.concatenate([sum(h) / len(h), sum(x * y for x, y in zip(h, e, strict=True)) / sum(e)])


@pytest.mark.parametrize(("kind", "jump"), [("gcn", True), ("gcn", False), ("gat", True), ("gat", False)])
def test_message_passing(spark, monkeypatch, kind, jump):
    monkeypatch.setattr(message_passing, "NODES_AT_ONCE", 20)
    rng = random.Random(kind)
    graphs = [([rng.randrange(4) for _ in range(n)], [(rng.randrange(5), rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]) for n in (1, 2, 5, 9, 30)] + [([3], [])]
    df = spark.createDataFrame([(k, t, e or None) for k, (t, e) in enumerate(graphs)] + [(99, None, None)], "sample_id long, type_ids array<int>, edges array<struct<edge_type int, src int, dst int>>")
    got = {r["sample_id"]: r["vector"] for r in message_passing.graph_vectors(df, 6, 2, kind, jump).collect()}
    for k, (t, e) in enumerate(graphs):
        assert np.allclose(got[k], vector_plainly(t, e, 6, 2, kind, jump, 7))
    assert got[99] == [0.0] * 12


def test_vectors_tell_more_than_summaries(spark):
    """Trees with the same nodes and depths, told apart by what is whose child: a flat summary can't know."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng, rows, labels = random.Random(0), [], []
    for k in range(120):
        label = k % 2
        kinds = ["root", "if", "for"] + (["call", "name"] if label else ["name", "call"]) * 1
        spare = rng.randint(0, 3)
        tree = [("root", -1, 0, 0), ("if", 0, 0, 1), (kinds[3], 1, 0, 2), ("for", 0, 1, 1), (kinds[4], 3, 0, 2)] + [("x", 0, 2 + j, 1) for j in range(spare)]
        rows += [(k, i, p, c, d, t, i) for i, (t, p, c, d) in enumerate(tree)]
        labels.append((k, label))
    tree = spark.createDataFrame(rows, "sample_id long, node_id int, parent_id int, child_pos int, depth int, type string, start int")
    y = spark.createDataFrame(labels, "sample_id long, label int")
    e = graph.edges(tree)
    vs = message_passing.graph_vectors(graph.assembled(graph.encoded(tree, graph.vocabulary(tree)), e)).select("sample_id", array_to_vector("vector").alias("features")).join(y, "sample_id").cache()
    flat = models.graph_summary(tree, e, ["if", "for", "call", "name", "x"])
    flat = flat.select("sample_id", array_to_vector(F.array(*(F.col(c).cast("double") for c in flat.columns[1:]))).alias("features")).join(y, "sample_id").cache()
    right = lambda d: LogisticRegression(maxIter=50).fit(d.where("sample_id < 80")).transform(d.where("sample_id >= 80")).where("prediction = label").count()
    assert right(vs) == 40 > 30 > right(flat)


def test_boosting_trains_on_distinct_rows(spark, monkeypatch):
    """Copies of all rows change neither the model nor how many rows a round goes over."""
    seen, whole = [], boosting.materialised
    monkeypatch.setattr(boosting, "materialised", lambda df, tag="table": seen.append(whole(df, tag)) or seen[-1])
    df = spark.createDataFrame([(float(i % 7), float(i % 3), i % 3 if i % 5 else 0) for i in range(60)], "a double, b double, label int").distinct()
    once = boosting.boosted(df, ["a", "b"], 3, rounds=2, depth=2)
    many = boosting.boosted(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("k"), ["a", "b"], 3, rounds=2, depth=2)
    flat = lambda t: [y for x in t for y in flat(x)] if isinstance(t, list) else [t]
    assert flat(many["rounds"]) == pytest.approx(flat(once["rounds"]))
    assert [x.count() for x in seen] == [df.count()] * 2


def test_own_perplexity_by_blocks(spark, monkeypatch):
    """A block sends each of its pairs and contexts once, whatever the number of its texts; many blocks and parts give the fitted model's
    perplexity, also for texts that are larger than a block."""
    same = spark.range(500).select(F.col("id").alias("ID"), F.lit("a b a b a").alias("code")).coalesce(1)
    held = vectors.token_blocks(same, "code", "ID").collect()
    assert sum(r["n"] for r in held) == 2500 and all(len(vectors.unpacked_numbers(r["vocab"])) == 2 and len(vectors._keys(r["sizes"], r["vocab"], r["codes"], 7, None)[3]) == 6 for r in held)
    monkeypatch.setattr(vectors, "AT_A_TIME", 60)
    monkeypatch.setattr(vectors, "TOKENS_A_TASK", 100)
    rng = random.Random(3)
    texts = [None, "", "é", *(" ".join(rng.choice("a b c d ( ) x1 7 the".split()) for _ in range(rng.randint(1, 150))) for _ in range(60))]
    df = spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(texts)], "ID string, code string").repartition(3)
    lm = vectors.fit_bigram_lm(df)
    for want, got in ((vectors.perplexity(df, lm), vectors.own_perplexity(df)), (vectors.windowed_perplexity(df, vectors.bigram_losses(lm), length=16, stride=8), vectors.own_perplexity(df, length=16))):
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        want, got = ({r["ID"]: r["perplexity"] for r in x.collect()} for x in (want, got))
        assert want.keys() == got.keys() and all(close(got[k], want[k]) for k in want)


def test_importances_are_of_a_whole_model(spark, monkeypatch):
    """The query asks for all rounds and the depth that boosting has by itself."""
    import inspect

    from codescope.plans import model_queries

    asked, whole = [], inspect.signature(boosting.boosted)
    monkeypatch.setattr(model_queries, "_flags", lambda spark, sf: None)
    monkeypatch.setattr(model_queries, "materialised", lambda df, tag: None)
    monkeypatch.setattr(model_queries, "rounded", lambda df: df)
    monkeypatch.setattr(boosting, "boosted", lambda *a, **b: asked.append(whole.bind(*a, **b)))
    monkeypatch.setattr(boosting, "permutation_importances", lambda *a, **b: None)
    model_queries.flag_importances(spark, "")
    assert all(asked[0].arguments.get(x, whole.parameters[x].default) == whole.parameters[x].default for x in ("rounds", "depth", "step"))
