"""Evaluation of predictions: everything follows from the confusion counts or from cumulative counts by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(probs: Column) -> Column:
    """The first position of the largest value."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def focal_loss(probs: Column, label: Column, gamma: float = 2.0, smoothing: float = 0.1, weights: list[float] | None = None, compat: bool = True) -> Column:
    """Focal loss of one row. With smoothing the target is spread over all classes; class weights then count only if compat is off."""
    log_p = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    k = F.size(probs)
    if smoothing > 0:
        target = F.transform(probs, lambda p, i: F.lit(smoothing) / k + F.when(i == label, 1 - smoothing).otherwise(0.0))
        loss = F.aggregate(F.zip_with(F.zip_with(target, log_p, lambda t, l: -t * l), probs, lambda x, p: x * F.pow(1 - p, F.lit(gamma))), F.lit(0.0), lambda a, x: a + x)
        if compat or not weights:
            return loss
    else:
        loss = -F.get(log_p, label) * F.pow(1 - F.get(probs, label), F.lit(gamma))
    return loss * F.get(F.array(*map(F.lit, weights)), label) if weights else loss


def confusion(df: DataFrame, truth: str = "label", pred: str = "prediction", classes: int | None = None) -> DataFrame:
    """(truth, pred, n) for all pairs of labels: 0 to classes - 1, or those that occur. Labels are few: a row a pair."""
    counts = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    dim = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("l")) if classes else counts.select(F.explode(F.array("truth", "pred")).alias("l")).distinct()
    grid = dim.select(F.col("l").alias("truth")).crossJoin(dim.select(F.col("l").alias("pred")))
    return grid.join(counts, ["truth", "pred"], "left").na.fill(0, ["n"])


def normalised_confusion(matrix: DataFrame) -> DataFrame:
    row = F.sum("n").over(Window.partitionBy("truth"))
    return matrix.withColumn("share", F.when(row == 0, 0.0).otherwise(F.col("n") / row))


def report(matrix: DataFrame, only_true: bool = False) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where a division by zero would be. only_true leaves out labels that are only
    predicted."""
    both = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    by = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    if only_true:
        by = by.where("support > 0")
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    by = by.withColumn("precision", part(F.col("hit"), F.col("predicted"))).withColumn("recall", part(F.col("hit"), F.col("support")))
    return by.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support", "hit")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted scores, balanced accuracy (over labels that occur in truth)."""
    r = report(matrix)
    return r.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def baseline(df: DataFrame, truth: str = "label") -> DataFrame:
    """The summary of always predicting the majority class."""
    from .profile import majority

    constant = df.crossJoin(F.broadcast(majority(df, truth))).select(truth, F.col("majority").alias("prediction"))
    return summary(confusion(constant, truth))


def collapsed(f1: float, base: float, within: float = 0.01) -> bool:
    return abs(f1 - base) < within


def misclassified(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    return df.withColumn("correct", F.col(truth) == F.col(pred)).where(~F.col("correct"))


def errors_per_class(df: DataFrame, n: int = 5, truth: str = "label", pred: str = "prediction", id_: str = "ID") -> DataFrame:
    """The first n errors of each true class by id."""
    return misclassified(df, truth, pred).withColumn("place", F.row_number().over(Window.partitionBy(truth).orderBy(id_))).where(F.col("place") <= n)


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, p, m): positives and others at each finite score."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    return ok.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("m"))


def thresholds(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """(score, p, m, tp, fp, pos, neg): counts at, and at or above, each distinct finite score. Scores are sorted by ranges, whose
    counts are summed first, so that no task holds all scores."""
    from .selection import running

    run = running(_by_score(df, score, label), [F.desc("score")], _tp="p", _fp="m")
    total = run.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("m"), F.lit(0)).alias("neg"))
    return run.crossJoin(F.broadcast(total)).select("score", "p", "m", (F.col("_tp") + F.col("p")).alias("tp"), (F.col("_fp") + F.col("m")).alias("fp"), "pos", "neg")


def roc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    return thresholds(df, score, label).withColumn("tpr", F.when(F.col("pos") == 0, 0.0).otherwise(F.col("tp") / F.col("pos"))).withColumn("fpr", F.when(F.col("neg") == 0, 0.0).otherwise(F.col("fp") / F.col("neg")))


def auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Area under the curve from pair counts: a positive beats the negatives below it and half of those beside it; 0.5 if a
    class is absent."""
    won = thresholds(df, score, label).agg(F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("m") / 2.0)).alias("w"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return won.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("w") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc"))


def youden(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: the threshold with the largest tpr - fpr, the highest of several."""
    return roc(df, score, label).withColumn("j", F.col("tpr") - F.col("fpr")).orderBy(F.desc("j"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "tpr", "fpr", "j")


def best_f1_threshold(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: the threshold with the best macro F1 of predicting 1 at or above it, the highest of several."""
    f = lambda tp, fp, fn: F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2.0 * tp / (2 * tp + fp + fn))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    scored = thresholds(df, score, label).withColumn("macro_f1", (f(tp, fp, fn) + f(tn, fn, fp)) / 2)
    return scored.orderBy(F.desc("macro_f1"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "macro_f1")


def perplexity_bundle(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: n_valid and n_infinite scores, the Youden threshold and its auc; 100.0 and 0.5 where no score is finite."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    counts = df.agg(F.count(F.when(finite, 1)).alias("n_valid"), F.count(F.when(~finite, 1)).alias("n_infinite"))
    best = youden(df, score, label).select("threshold")
    return counts.crossJoin(F.broadcast(auc(df, score, label))).join(F.broadcast(best), F.lit(True), "left").select("n_valid", "n_infinite", F.coalesce("threshold", F.lit(100.0)).alias("threshold"), "auc")


def perplexity_report(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: what a threshold on perplexity is worth. The counts, threshold and auc of perplexity_bundle(), then, over finite
    scores, accuracy and macro F1 of predicting 1 below the threshold, and mean, deviation and median of the scores of class 0 and 1
    (0.0 where a class has none)."""
    from .profile import score_stats

    bundle = perplexity_bundle(df, score, label)
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    guessed = finite.crossJoin(F.broadcast(bundle.select("threshold"))).select(label, F.when(F.col(score) < F.col("threshold"), 1).otherwise(0).alias("prediction"))
    worth = summary(confusion(guessed, label)).select(F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))
    of = score_stats(finite, score, label, classes=2)
    stats = of.agg(*(F.max(F.when(F.col(label) == k, F.col(c))).alias(f"{c}_{k}") for k in (0, 1) for c in ("mean", "std", "median")))
    return bundle.crossJoin(F.broadcast(worth)).crossJoin(F.broadcast(stats))


def threshold_predictions(df: DataFrame, score: str, at: float) -> DataFrame:
    """1 below the threshold; 0 at or above it and for scores that aren't finite."""
    return df.withColumn("prediction", F.when(F.col(score).isNull() | F.isnan(score), 0).when(F.col(score) < at, 1).otherwise(0))


def best_epoch(history: DataFrame, metric: str = "val_f1", patience: int = 3) -> DataFrame:
    """history (epoch, metric) with best (so far), improved, wait (epochs since) and stopped. A row an epoch."""
    w = Window.orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("best", F.max(metric).over(w)).withColumn("improved", before.isNull() | (F.col(metric) > before))
    h = h.withColumn("_last", F.max(F.when(F.col("improved"), F.col("epoch"))).over(w)).withColumn("wait", F.col("epoch") - F.col("_last")).drop("_last")
    return h.withColumn("stopped", F.max((F.col("wait") >= patience).cast("int")).over(w) == 1)
