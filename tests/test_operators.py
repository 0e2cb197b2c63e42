"""Operators on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codescope.operators import augment, clean, graph, joins, metrics, models, profile, sampling, submission, vectors
from codescope.sources import io


def values(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(i, f"text {i}", "en" if i % 10 < 6 else "fr" if i % 10 < 9 else "de", int(i % 7 == 0)) for i in range(200)]
    return spark.createDataFrame(rows, "ID long, code string, language string, label int").cache()


def test_clean(spark):
    df = spark.createDataFrame([(1, " x ", 0), (2, " \n\t", 1), (3, None, 1), (4, "y", None)], "ID long, code string, label int")
    assert values(clean.clean(df), "ID") == [(1,)]
    assert values(clean.drop_null(df, "code", "label"), "ID") == [(1,), (2,)]
    with pytest.raises(ValueError, match="missing"):
        clean.require(df, "nope")
    codes = ["#include <x>\ncout", "#include <x>", "public class A", "<?php", "package main", "function f()", "def f", None]
    langs = spark.createDataFrame(list(enumerate(codes)), "ID long, code string").select("ID", clean.detect_language(F.col("code")).alias("l"))
    assert [x[1] for x in values(langs)] == ["C++", "C", "Java", "PHP", "Go", "JavaScript", "Python", "Python"]


def test_labels(spark):
    df = spark.createDataFrame([(5,), (9,), (5,), (None,)], "label int")
    d = clean.dense_labels(df)
    assert values(d) == [(5, 0), (9, 1)]
    assert values(clean.unseen_labels(spark.createDataFrame([(7,), (5,)], "label int"), d)) == [(7,)]


def test_profile_invariants(groups):
    same = profile.leakage(groups, groups).first()
    assert same["percent"] == 100.0 and same["warn"]
    w = profile.class_weights(groups, 3).collect()
    assert sum(r["weight"] for r in w) / 3 == pytest.approx(1)
    assert profile.duplicates(groups).first()["n_duplicates"] == 0
    assert profile.majority(groups).first()[0] == 0


def test_sampling(groups):
    n = dict(values(sampling.cap(groups, ["language"], 30).groupBy("language").count()))
    assert n == {"en": 30, "fr": 30, "de": 20}
    n = dict(values(sampling.water_filled(groups, 100, "language").groupBy("language").count()))
    assert n == {"de": 20, "fr": 40, "en": 40}
    n = dict(values(sampling.proportional(groups, 11, "language").groupBy("language").count()))
    assert n == {"en": 6, "fr": 3, "de": 1}
    assert set(dict(values(sampling.equal_groups(groups, "language").groupBy("language").count())).values()) == {20}
    split = sampling.stratified_split(groups, 0.7).groupBy("label", "split").count()
    assert values(split)[0][2] + values(split)[1][2] + values(split)[2][2] + values(split)[3][2] == 200
    assert values(sampling.sample_rows(groups, 10), "ID") == values(sampling.sample_rows(groups.repartition(7), 10), "ID")
    assert sampling.balance_cap(50_000, 8, 11) == 550 and sampling.balance_cap(10, 5, 5) == 50


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ID long, v string")
    b = spark.createDataFrame([(1, "z")], "ID long, v string")
    assert joins.suffixed(a, b, "ID").columns == ["ID", "v_pred", "v_true"]
    assert values(joins.lookup(a, b, "ID", "v", "none")) == [(1, "z"), (2, "none")]
    with pytest.raises(ValueError):
        joins.zipped("ID", a, b)
    t = spark.createDataFrame([("", 0, [9.0]), ("p", 1, [1.0])], "text string, text_idx int, embedding array<double>")
    n = spark.createDataFrame([(1, "p"), (2, "q")], "ID long, text string")
    assert values(joins.embedding_lookup(n, t, 1).select("ID", "embedding")) == [(1, [1.0]), (2, [0.0])]
    assert values(joins.embedding_lookup(n, t, 1, compat=True).select("ID", "embedding")) == [(1, [1.0]), (2, [9.0])]


def test_metrics_against_model(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(4), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(data, "ID long, label int, prediction int")
    m = metrics.confusion(df)
    assert m.agg(F.sum("n")).first()[0] == 300
    f1 = []
    for c in range(4):
        tp, p, t = sum(a == b == c for _, a, b in data), sum(b == c for _, _, b in data), sum(a == c for _, a, _ in data)
        f1.append(2 * tp / (p + t) if p + t and tp else 0)
    s = metrics.summary(m).first()
    assert s["macro_f1"] == pytest.approx(sum(f1) / 4) and s["accuracy"] == pytest.approx(sum(a == b for _, a, b in data) / 300)


@pytest.mark.parametrize("scores", [[0.1, 0.1, 0.5, 0.9, 0.9, 0.4], [1.0] * 6, [0.3, float("nan"), float("inf"), 0.2, 0.8, 0.1]])
def test_roc(spark, scores):
    data = [(x, k % 2) for k, x in enumerate(scores)]
    df = spark.createDataFrame(data, "score double, label int")
    ok = [(s, y) for s, y in data if math.isfinite(s)]
    pos, neg = [s for s, y in ok if y], [s for s, y in ok if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else 0.5
    assert metrics.auc(df, "score").first()[0] == pytest.approx(want)
    best = metrics.youden(df, "score").first()
    j = max((sum(p >= t for p in pos) / len(pos) - sum(q >= t for q in neg) / len(neg), t) for t, _ in ok)
    assert (best["j"], best["threshold"]) == (pytest.approx(j[0]), j[1])


def test_history_and_argmax(spark):
    h = spark.createDataFrame([(e, v) for e, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.1, 0.5])], "epoch long, val_f1 double")
    got = {r["epoch"]: (r["improved"], r["wait"], r["stopped"]) for r in metrics.best_epoch(h).collect()}
    assert got[1] == (True, 0, False) and got[4] == (False, 3, True) and got[5] == (True, 0, True)
    p = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>").select(metrics.argmax(F.col("p")), metrics.softmax(F.col("p"))).first()
    assert p[0] == 1 and sum(p[1]) == pytest.approx(1)


def test_submission(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "ID long")
    made = submission.submission(ids, spark.createDataFrame([(1, 1), (2, 1)], "ID long, prediction int"))
    assert values(made) == [(1, 1), (2, 1), (3, 1)]
    submission.validate(made, ids, 2)
    bad = spark.createDataFrame([(1, 5), (1, None), (9, 0)], "ID long, label int")
    found = {r["check"]: r["violations"] for r in submission.checks(bad, ids, 2).collect()}
    assert found == {"columns": 0, "duplicate_ids": 1, "null_labels": 1, "missing_ids": 2, "extra_ids": 1, "invalid_labels": 1, "row_count": 0}
    with pytest.raises(ValueError, match="columns"):
        submission.validate(bad.withColumnRenamed("label", "x"), ids, 2)


def test_trees(spark):
    df = spark.createDataFrame([(1, "x = f(1)\nif x:\n    y = 2\n", "python"), (2, "not python (", "python"), (3, "<p>a<b>c</b></p>", "html"), (4, "z", "cobol")], "ID long, code string, language string")
    t = graph.nodes(df).cache()
    assert values(graph.unparsed(df, t), "ID") == [(2,), (4,)]
    assert values(graph.subtree_sizes(t).where("subtree <> size")) == []
    e = graph.edges(t).collect()
    kinds = {(r["sample_id"], r["src"], r["dst"], r["edge_type"]) for r in e}
    assert all((s, b, a, {0: 1, 1: 0}.get(k, k)) in kinds for s, a, b, k in kinds)
    html = [(r["type"], r["depth"]) for r in t.where("sample_id = 3").orderBy("node_id").collect()]
    assert html == [("document", 0), ("p", 1), ("#text", 2), ("b", 2), ("#text", 3)]
    one = t.where("sample_id = 3 AND node_id = 0")
    assert values(graph.edges(one)) == [(3, 0, 0, 0)]
    v = graph.vocabulary(t, 3)
    assert v.count() == 2 and graph.encoded(t, v).where("type_id = 0").count() > 0
    assert all(0 <= x <= 1 for r in graph.structural_features(t).drop("sample_id", "node_id").collect() for x in r)


def test_tfidf_and_windows(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "a a d"), (3, "")], "ID long, code string")
    fitted = vectors.fit_tfidf(df, size=3)
    idf = {r["term"]: r["idf"] for r in fitted.collect()}
    assert idf["a"] == pytest.approx(math.log(4 / 3) + 1) and idf["b"] == pytest.approx(math.log(4 / 2) + 1)
    norm = vectors.tfidf(df, fitted).groupBy("ID").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in norm)
    for n in (0, 1, 512, 513, 768, 2000):
        w = spark.range(1).select(vectors.windows(F.lit(n)).alias("w")).first()["w"]
        assert sum(x["target"] for x in w) == n and (not w or w[-1]["end"] == n)
    assert {r["ID"]: math.isinf(r["perplexity"]) for r in vectors.perplexity(df, vectors.fit_bigram_lm(df)).collect()} == {1: False, 2: False, 3: True}


def test_tfidf_counts_by_text_what_it_needs(spark):
    """Texts without an id have weights; only the terms asked for are shuffled by text; arrays of tokens do as well as texts."""
    df = spark.createDataFrame([(1, "a b b c"), (2, "a a d"), (None, "a b"), (4, None)], "ID long, code string")
    t = vectors.tokenised(df)
    fitted = vectors.fit_tfidf(t, size=2)
    assert sorted(map(tuple, fitted.collect())) == sorted(map(tuple, vectors.fit_tfidf(df, size=2).collect()))
    idf = {r["term"]: r["idf"] for r in fitted.collect()}
    assert idf == {"a": pytest.approx(math.log(5 / 4) + 1), "b": pytest.approx(math.log(5 / 3) + 1)}
    got = {(r["ID"], r["term"]): r["weight"] for r in vectors.tfidf(t, fitted).collect()}
    norm = math.hypot(idf["a"], idf["b"])
    assert got.keys() == {(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "b")} and got[None, "a"] == pytest.approx(idf["a"] / norm)
    assert {(r["ID"], r["term"]): r["weight"] for r in vectors.tfidf(df, fitted).collect()} == pytest.approx(got)
    assert {(r["ID"], r["term"], r["tf"]) for r in vectors.term_counts(df, of=fitted).collect()} == {(1, "a", 1), (1, "b", 2), (2, "a", 2), (None, "a", 1), (None, "b", 1)}


def test_renamed_leaves_texts_beyond_the_parser():
    deep = "~" * 20000 + "value"
    with pytest.raises(MemoryError):
        compile(deep, "", "eval")
    assert augment.renamed(deep) == deep


def test_augment(spark, groups):
    code = "def area(width, height):\n    total = width * height\n    return total\n"
    out = augment.renamed(code)
    assert "width" not in out and "var_" in out and "def" in out
    lines = "\n".join(["    four", "\tone", "none", "", "  "] * 400)
    df = spark.createDataFrame([(1, lines), (2, None), (3, "")], "ID long, code string")
    form, note = (df.select("ID", f(F.col("code"), F.col("ID"), 7).alias("c")).collect() for f in (augment.reformatted, augment.commented))
    got = form[0]["c"].split("\n")
    assert set(got) == {" " * 8 + "four", "    four", "  four", "  one", " one", "none", ""} and form[1]["c"] is None
    assert 0.25 < got.count("        four") / 400 < 0.35 and 0.14 < got.count("  four") / 400 < 0.26 and 0 < len([x for x in got if not x]) - 800 < 130
    added = [x for x in note[0]["c"].split("\n") if x.strip() in augment.COMMENTS]
    assert 110 < len(added) < 210 and {len(x) - len(x.lstrip()) for x in added} == {0, 1, 2, 4} and note[1]["c"] is None
    kept = [x for x in note[0]["c"].split("\n") if x.strip() not in augment.COMMENTS]
    assert kept == lines.split("\n")
    once = values(augment.augmented(df.repartition(3), 5))
    assert once == values(augment.augmented(df, 5))
    more = augment.with_augmented(groups, 0.2)
    assert 210 < more.count() < 270 and more.select("ID").distinct().count() == 200


def test_many_scores(spark):
    """Cumulative counts don't depend on how a sort happens to be cut into partitions."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=200_000), rng.integers(0, 2, 200_000)
    order = np.argsort(x)
    ranks = np.empty(len(x))
    ranks[order] = np.arange(1, len(x) + 1)
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "score double, label int")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts, aqe in (("64", "true"), ("8", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            assert metrics.auc(df, "score").first()[0] == pytest.approx(want, abs=1e-12)
            ids = io.ensure_id(df, ["score"]).orderBy("ID").select("ID", "score").toPandas()
            assert ids["ID"].tolist() == list(range(len(x))) and (ids["score"].to_numpy() == x[order]).all()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_perplexity_bundle(spark):
    df = spark.createDataFrame([(1.0, 1), (float("inf"), 0), (None, 0), (2.0, 0)], "score double, label int")
    assert tuple(metrics.perplexity_bundle(df, "score").first()) == (2, 2, 1.0, 0.0)
    assert tuple(metrics.perplexity_bundle(df.where("score = double('infinity')"), "score").first()) == (0, 1, 100.0, 0.5)


def test_html_that_cannot_be_parsed(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "html"), (2, "<![foo[x]]>", "html"), (3, "", "html"), (4, None, "html")], "ID long, code string, language string")
    assert {r["sample_id"] for r in graph.nodes(df).collect()} <= {1, 2} and 1 in {r["sample_id"] for r in graph.nodes(df).collect()}


def test_samplers_hold_no_group(spark):
    """Ranks by part of the draw are those of a sort of the whole group."""
    df = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(3000)], "ID long, g int")
    got = {r["ID"]: r["_r"] for r in sampling._ranked(df, ["g"], "ID", 42).collect()}
    rows = df.withColumn("d", sampling.draw()).collect()
    for g in (0, 1, 2, None):
        for place, r in enumerate(sorted((r for r in rows if r["g"] == g), key=lambda r: (r["d"], r["ID"])), 1):
            assert got[r["ID"]] == place


def test_hybrid_head(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [float(i % 2) + rng.random() / 4, rng.random()], rng.random(), i % 2) for i in range(120)], "ID long, e array<double>, f double, label int")
    model = models.hybrid_head(df, "e", ["f"], 2, 2, hidden=(4,))
    assert models.predicted(model, df).where("prediction = label").count() > 110


def test_models(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, float(y := i % 2) + rng.random(), rng.random(), y) for i in range(200)], "ID long, a double, b double, label int")
    m = models.boosted_trees(df, ["a", "b"], iterations=3, depth=2)
    p = models.predicted(m, df)
    assert p.where("prediction = label").count() > 180 and models.importances(m, ["a", "b"])[0][0] == "a"
    meta = models.stacker(p.select("ID", "label", F.col("probs").alias("features")), 2, 2)
    assert models.stacked(meta, p.select("ID", "label", F.col("probs").alias("features"))).where("prediction = label").count() > 180
    scored = models.Provider(lambda: lambda texts: [len(t) for t in texts], "long").apply(spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "c")], "ID long, t string"), "t", "ID", "n")
    assert values(scored) == [(1, 2), (2, 2), (3, 1)]


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, code string")
    assert io.conform(df).columns == ["ID", "code", "language", "generator", "label"]
    with pytest.raises(ValueError):
        io.conform(df.drop("code"))
    path = str(tmp_path / "t")
    assert io.cached_parquet(spark, path, lambda: df).count() == 1 and io.cached_parquet(spark, path, lambda: 1 / 0).count() == 1
    assert io.resolve_source(spark, [str(tmp_path / "no"), path]) == path
    io.write_csv(df, str(tmp_path / "c"), ["id"])
    assert values(io.read_csv(spark, str(tmp_path / "c"), "id long, code string")) == [(1, "x")]
    ids = io.ensure_id(spark.createDataFrame([(c,) for c in "dbca"], "code string"), ["code"])
    assert values(ids) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert values(io.label_map(spark, '{"human": 0, "machine": 1}')) == [(0, "human"), (1, "machine")]


def test_stream(spark, tmp_path):
    from codescope.streaming.scorer import feature_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "ab"), (2, "c")], "ID long, code string").write.parquet(src)
    feature_stream(spark, src, "ID long, code string", lambda d: d.select("ID", F.length("code").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert values(spark.read.parquet(str(tmp_path / "out"))) == [(1, 2), (2, 1)]


def test_entry():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "signature_gpt" in q
