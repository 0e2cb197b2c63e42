"""Order, selection, and what is kept between sessions."""

import random

import pytest
from pyspark.sql import functions as F

from codescope.operators import graph, sampling, selection, vectors
from codescope.sources import fitted, io


@pytest.mark.parametrize(("n", "step", "few"), [(0, 3, 5), (1, 3, 5), (37, 1, 5), (300, 2, 1), (419, 3, 10_000), (420, 3, 5), (500, 3, 5)])
def test_first_rows(spark, monkeypatch, n, step, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(n)
    keys = ["".join(rng.choice("abé日") for _ in range(rng.randint(0, 6))) for _ in range(400)] + ["same" * 5] * 18 + [None] * 2
    df = spark.createDataFrame([(k, x) for k, x in enumerate(keys)], "ID long, k string").repartition(3)
    got = selection.first_rows(df, F.col("k"), n, step)
    assert sorted((r["k"] or "").encode() for r in got.collect()) == sorted((x or "").encode() for x in keys)[:n]


def test_sample_rows_plan(spark):
    df = spark.range(5000).select(F.col("id").alias("ID"), F.repeat(F.lit("x"), 100).alias("code"))
    got = sampling.sample_rows(df, 700)
    whole = df.orderBy(sampling.draw(), "ID").limit(700)
    assert sorted(got.collect()) == sorted(whole.collect())
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_node_texts(spark):
    rng = random.Random(3)
    texts = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(300)]
    tree = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = sorted(((t, texts.count(t)) for t in set(texts)), key=lambda x: (-x[1], x[0]))
    for most in (1, 5, 12, 100):
        assert [tuple(r) for r in graph.node_texts(tree, most).collect()] == sorted(plain[:most])


def test_numbering_of_equal_first_keys(spark):
    df = spark.range(20_000).select(F.lit(1).alias("a"), F.pmod(F.xxhash64("id"), F.lit(977)).alias("b"), F.col("id").alias("c"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        one = io.ensure_id(df.repartition(7), ["a"])
        sizes = [r["n"] for r in one.groupBy(F.floor(F.col("ID") / 1250)).agg(F.count("*").alias("n")).collect()]
        assert sizes == [1250] * 16
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in io.ensure_id(df.repartition(3), ["a"]).collect()}
        held = selection.running(df, [F.col("a"), F.xxhash64("c")]).groupBy("_place").count().where("count > 1").count()
        assert held == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.randint(0, 5)) for _ in range(500)]
    got = sorted(selection.running(spark.createDataFrame(rows, "s double, p int").repartition(4), [F.desc("s")], before="p").collect(), key=lambda r: r["_place"])
    total = 0
    for k, (r, (s, p)) in enumerate(zip(got, sorted(rows, reverse=True), strict=True)):
        assert (r["_place"], r["s"], r["before"]) == (k, s, total)
        total += p


def test_fitted_tables(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b b"), (2, "b c")], "ID long, code string")
    path, model = str(tmp_path / "tfidf"), vectors.fit_tfidf(texts, size=2)
    with pytest.raises(FileNotFoundError):
        fitted.load_fitted(spark, path, "tfidf")
    fitted.save_fitted(model, path, "tfidf", size=2)
    again = fitted.load_fitted(spark.newSession(), path, "tfidf", size=2)
    assert sorted(again.collect()) == sorted(model.collect())
    for kind, settings in (("tfidf", {"size": 3}), ("tfidf", {}), ("vocabulary", {"size": 2})):
        with pytest.raises(ValueError, match="otherwise"):
            fitted.load_fitted(spark, path, kind, **settings)
    fitted.VERSION += 1
    try:
        with pytest.raises(ValueError, match="version"):
            fitted.load_fitted(spark, path, "tfidf", size=2)
    finally:
        fitted.VERSION -= 1
    model.limit(1).write.mode("overwrite").parquet(f"{path}/table")
    with pytest.raises(ValueError, match="manifest"):
        fitted.load_fitted(spark, path, "tfidf", size=2)


def test_cached_chunks(spark, tmp_path):
    import shutil

    samples = spark.createDataFrame([(k, f"f({k}, x{k});", "c") for k in range(40)], "ID long, code string, language string")
    built = []

    def build(part):
        built.append(part.count())
        return graph.nodes(part)

    read = lambda **how: sorted(fitted.cached_chunks(samples, str(tmp_path), fitted.cache_key(**how), build, chunk_rows=10).collect())
    first = read(max_nodes=512)
    assert first == sorted(graph.nodes(samples).collect()) and built == [40]
    assert read(max_nodes=512) == first and built == [40]  # a hit builds nothing
    folder = next(p for p in tmp_path.iterdir() if p.is_dir())
    shutil.rmtree(folder / "chunk=1")
    next(f for f in (folder / "chunk=3").iterdir() if f.name.endswith(".parquet")).unlink()
    assert read(max_nodes=512) == first and built[0] == 40 and 0 < built[1] < 40  # lost chunks alone
    assert read(max_nodes=100) == first and built[2] == 40  # another setting is another cache
    vocabulary = graph.vocabulary(graph.nodes(samples))
    assert fitted.cache_key(vocabulary, a=1) == fitted.cache_key(vocabulary, a=1) != fitted.cache_key(vocabulary.limit(2), a=1)


def test_small_sources(spark, tmp_path):
    """A labelled test sample, JSON and subsets."""
    from codescope.operators import profile

    df = spark.createDataFrame([(1, "x", 0), (2, None, 1), (3, "y", None)], "id long, code string, label int")
    df.write.parquet(str(tmp_path / "sample"))
    got = io.labelled_test(spark, [str(tmp_path / "absent"), str(tmp_path / "sample")])
    assert [(r["ID"], r["code"], r["label"]) for r in got.collect()] == [(1, "x", 0)]
    io.write_json(df, str(tmp_path / "json"))
    assert sorted(io.read_json(spark, str(tmp_path / "json"), df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    assert profile.is_subset(df.where("id < 3"), df, "id") and not profile.is_subset(df, df.where("id < 3"), "id")
