"""Gradient boosting over any number of classes that can stop by macro F1, be evaluated by stages, saved and resumed.

A round fits one regression tree of Spark ML a class to the residuals of the classes' probabilities (softmax of the margins so far)
and adds a step of it to the margins. Trees are taken over as plain numbers, so that a model is a small JSON text, and scoring is
an expression. A round depends on the rows, the settings and the rounds before alone: the first k rounds of a model are the model
of k rounds, and resuming is the same as not having stopped."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialised
from . import metrics
from .models import weighted

#: Margins are written anew after so many rounds, so that no plan has more trees than these.
ROUNDS_A_TABLE = 8


def tree_of(model) -> list:
    """A fitted tree as [feature, threshold, left, right] and numbers. Its features are all continuous."""

    def of(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        return [node.split().featureIndex(), node.split().threshold(), of(node.leftChild()), of(node.rightChild())]

    return of(model._java_obj.rootNode())


def value(tree, features: list[str]) -> Column:
    """A tree as an expression; as in Spark ML, NaN goes right."""
    if not isinstance(tree, list):
        return F.lit(float(tree))
    k, at, left, right = tree
    return F.when(F.col(features[k]).cast("double") <= at, value(left, features)).otherwise(value(right, features))


def with_margins(df: DataFrame, model: dict, after: int = 0) -> DataFrame:
    """df with _m, an array of a margin a class: that of df's own _m, which holds the first rounds, and the rounds from after on."""
    out = df if after else df.withColumn("_m", F.array(*(F.lit(0.0) for _ in range(model["classes"]))))
    # one sum a class, not a column a round: a plan has one projection however many rounds there are
    if rounds := model["rounds"][after:]:
        sums = []
        for k in range(model["classes"]):
            total = F.get("_m", F.lit(k))
            for trees in rounds:
                total = total + model["step"] * value(trees[k], model["features"])
            sums.append(total)
        out = out.withColumn("_m", F.array(*sums))
    return out


def boosted(df: DataFrame, features: list[str], classes: int, rounds: int = 50, depth: int = 5, step: float = 0.3, label: str = "label", seed: int = 42, validation: DataFrame | None = None, patience: int = 10, resume: dict | None = None) -> dict:
    """A model of so many rounds in all, those of resume included. With validation, training stops when its macro F1 hasn't risen for
    patience rounds, and the model is cut to the best round (the first of several); history has the scores."""
    model = json.loads(json.dumps(resume)) if resume else {"classes": classes, "features": features, "step": step, "depth": depth, "seed": seed, "rounds": [], "history": []}
    if resume and (model["classes"], model["features"], model["step"], model["depth"], model["seed"]) != (classes, features, step, depth, seed):
        raise ValueError("a model is resumed with the settings that it was begun with")
    own = weighted(df.where(F.col(label).isNotNull()), classes, label).select(F.col(label).cast("int").alias("_y"), "weight", *(F.col(f).cast("double").alias(f) for f in features))
    # rows that agree in all that a tree sees are one row of as much weight
    own = own.groupBy("_y", *features).agg((F.count("*") * F.max("weight")).alias("weight"))
    put = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    now = materialised(with_margins(own, model), "boosting")
    val = None if validation is None else materialised(with_margins(validation, model), "boosting-validation")
    for r in range(len(model["rounds"]), rounds):
        p = metrics.softmax(F.col("_m"))
        held = put.transform(now.withColumn("_p", p))
        fit = lambda k: DecisionTreeRegressor(featuresCol="_x", labelCol="_r", weightCol="weight", maxDepth=depth, seed=seed + r).fit(held.withColumn("_r", (F.col("_y") == k).cast("double") - F.get("_p", F.lit(k))))  # noqa: B023, E731
        model["rounds"].append([tree_of(fit(k)) for k in range(classes)])
        now = with_margins(now, model, r) if r else with_margins(now.drop("_m"), model)
        if (r + 1) % ROUNDS_A_TABLE == 0:
            now = materialised(now, "boosting")
        if val is not None:
            val = materialised(with_margins(val, model, r) if r else with_margins(val.drop("_m"), model), "boosting-validation")
            score = metrics.summary(metrics.confusion(val.withColumn("prediction", metrics.argmax(F.col("_m"))), label)).first()["macro_f1"]
            model["history"] = [*model["history"][:r], score]
            if len(model["history"]) - 1 - best_round(model["history"]) >= patience:
                break
    if val is not None and model["history"]:
        keep = best_round(model["history"]) + 1
        model["rounds"], model["history"] = model["rounds"][:keep], model["history"][:keep]
    return model


def best_round(history: list[float]) -> int:
    return max(range(len(history)), key=lambda k: (history[k], -k))


def predicted(df: DataFrame, model: dict) -> DataFrame:
    """df with probs and prediction."""
    return with_margins(df, model).withColumn("probs", metrics.softmax(F.col("_m"))).withColumn("prediction", metrics.argmax(F.col("_m"))).drop("_m")


def staged(df: DataFrame, model: dict, label: str = "label") -> DataFrame:
    """(stage, accuracy, macro_f1): the model cut to its first stages, from 1 on, in one pass. Each row's trees are added up once into an
    array of a prediction a stage, and all stages share one table of counts, of classes by classes by stages."""
    k = range(model["classes"])
    values = F.array(*(F.array(*(model["step"] * value(t, model["features"]) for t in trees)) for trees in model["rounds"]))
    start = F.struct(F.array(*(F.lit(0.0) for _ in k)).alias("m"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, v: Column) -> Column:
        m = F.zip_with(a["m"], v, lambda x, y: x + y)
        return F.struct(m.alias("m"), F.concat(a["out"], F.array(metrics.argmax(m))).alias("out"))

    each = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("truth"), F.posexplode(F.aggregate(values, start, add)["out"]).alias("stage", "pred"))
    n = each.groupBy("stage", "truth", "pred").agg(F.count("*").alias("n"))
    return by_class(n, "stage").select((F.col("stage") + 1).alias("stage"), "accuracy", "macro_f1")


def by_class(counts: DataFrame, of: str) -> DataFrame:
    """counts (of, truth, pred, n), a row a pair that occurs -> (of, accuracy, macro_f1), over the classes that occur in either."""
    both = counts.select(of, F.explode(F.array(F.struct(F.col("truth").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x")).select(of, "x.*")
    by = both.groupBy(of, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return by.groupBy(of).agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def save(model: dict) -> str:
    return json.dumps(model)


def load(text: str) -> dict:
    return json.loads(text)


#: Rows that swap values with each other, about; a row has as many partners whatever the number of rows.
SWAPPED = 512


def permutation_importances(score, df: DataFrame, features: list[str], label: str = "label", id_: str = "ID", seed: int = 42) -> DataFrame:
    """(feature, importance): how much macro F1 falls when the values of that feature alone are swapped between rows. score takes
    a table and returns it with prediction; any model and number of classes will do. Rows are dealt by a hash of their id to groups of
    about SWAPPED, and in a group, in order of another hash, feature k is taken from the row k + 1 places on, around the end. So
    all features, and the rows as they are, are scored in one pass, as so many copies. ids must be unique, or groups grow."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_y"), F.struct(*(F.col(f) for f in features)).alias("_f"))
    groups = max(1, -(-rows.count() // SWAPPED))
    dealt = rows.groupBy(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(groups)).alias("_g")).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("_id", F.lit(seed + 1)).alias("h"), "_id", "_y", "_f"))).alias("_all"))
    each = dealt.select("_all", F.posexplode("_all").alias("_at", "_row"))
    other = lambda k: F.get("_all", (F.col("_at") + k + 1) % F.size("_all"))["_f"]
    variants = F.array(F.struct(F.lit(-1).alias("of"), F.col("_row._f").alias("f")), *(F.struct(F.lit(k).alias("of"), F.struct(*((other(k) if j == k else F.col("_row._f"))[f].alias(f) for j, f in enumerate(features))).alias("f")) for k in range(len(features))))
    copies = each.select(F.col("_row._y").alias("_y"), F.explode(variants).alias("v")).select("_y", F.col("v.of").alias("_of"), "v.f.*")
    n = score(copies).groupBy("_of", F.col("_y").alias("truth"), F.col("prediction").cast("int").alias("pred")).agg(F.count("*").alias("n"))
    f1 = by_class(n, "_of").select("_of", "macro_f1")
    names = F.array(*map(F.lit, features))
    whole = f1.where("_of = -1").select(F.col("macro_f1").alias("_whole"))
    return f1.where("_of >= 0").crossJoin(F.broadcast(whole)).select(F.get(names, F.col("_of")).alias("feature"), (F.col("_whole") - F.col("macro_f1")).alias("importance"))
