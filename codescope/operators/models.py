"""Training and scoring with Spark ML, and interfaces for models that aren't here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import class_weights


def weighted(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """df with weight, balanced over the classes that occur. A row a class is broadcast."""
    w = class_weights(df, classes, "balanced", label).select(F.col(label).alias("_l"), "weight")
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")


def boosted_trees(df: DataFrame, features: list[str], classes: int = 2, iterations: int = 50, depth: int = 5, step: float = 0.1, label: str = "label", seed: int = 42, validation: str | None = None):
    """Gradient-boosted trees: direct for two classes, one against the rest for more."""
    one = GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed, weightCol="weight")
    if validation:
        one = one.setValidationIndicatorCol(validation)
    last = one if classes == 2 else OneVsRest(classifier=one, labelCol=label, featuresCol="features", weightCol="weight")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), last]).fit(weighted(df, classes, label))


def forest(df: DataFrame, features: list[str], classes: int, trees: int = 50, depth: int = 8, label: str = "label", seed: int = 42):
    last = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), last]).fit(weighted(df, classes, label))


def predicted(model, df: DataFrame) -> DataFrame:
    """df with prediction and, where the model has them, probs."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability")


def importances(model, features: list[str], k: int = 10) -> list[tuple[str, float]]:
    """The k features that count most; ties by name. Only of models that have importances; boosting.permutation_importances() is for
    all, those of one class against the rest too."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def stacker(df: DataFrame, size: int, classes: int, kind: str = "logistic", features: str = "features", label: str = "label", seed: int = 42):
    """A meta-learner over stacked probability arrays of the given size."""
    v = df.withColumn("features", array_to_vector(F.col(features)))
    if kind == "logistic":
        return LogisticRegression(labelCol=label, maxIter=200, weightCol="weight").fit(weighted(v, classes, label))
    return MultilayerPerceptronClassifier(labelCol=label, layers=[size, 64, 32, classes], maxIter=200, seed=seed).fit(v)


def stacked(model, df: DataFrame, features: str = "features") -> DataFrame:
    return predicted(model, df.withColumn("features", array_to_vector(F.col(features))))


def hybrid_head(df: DataFrame, embedding: str, features: list[str], size: int, classes: int, hidden=(256, 128), label: str = "label", seed: int = 42):
    """A perceptron over an embedding of that size and handcrafted features, both scaled; predicted() takes it."""
    parts = [f"_e{k}" for k in range(size)]
    cut = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{embedding}`[{k}] AS DOUBLE) AS {c}" for k, c in enumerate(parts)) + " FROM __THIS__")
    stages = [cut, VectorAssembler(inputCols=[*parts, *features], outputCol="_v", handleInvalid="keep"), StandardScaler(inputCol="_v", outputCol="features", withMean=True), MultilayerPerceptronClassifier(labelCol=label, layers=[size + len(features), *hidden, classes], maxIter=100, seed=seed)]
    return Pipeline(stages=stages).fit(df)


def graph_summary(tree: DataFrame, edge_table: DataFrame, types: list[str]) -> DataFrame:
    """A row a sample for a flat classifier: shares of node types, counts of edge kinds, mean depth and size."""
    n = tree.groupBy("sample_id").agg(F.count("*").alias("n_nodes"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"), *(F.avg((F.col("type") == t).cast("double")).alias(f"type_{k}") for k, t in enumerate(types)))
    e = edge_table.groupBy("sample_id").agg(*(F.count_if(F.col("edge_type") == k).alias(f"edges_{k}") for k in range(4)))
    return n.join(e, "sample_id", "left").na.fill(0)


class Provider:
    """A model from outside: run(texts) -> a list of rows, in batches on executors. load() is called once a worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list]], kind: str):
        self.load, self.kind = load, kind

    def apply(self, df: DataFrame, text: str, id_: str, out: str, batch: int = 64) -> DataFrame:
        """(id, out): distinct texts are scored once and joined back."""
        load, made = self.load, {}

        def run(batches):
            import pyarrow as pa

            if "f" not in made:
                made["f"] = load()
            for b in batches:
                for lo in range(0, b.num_rows, batch):
                    part = b.slice(lo, batch)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made["f"](part.column(0).to_pylist()))], names=["_t", out])

        scored = df.select(F.col(text).alias("_t")).distinct().mapInArrow(run, f"_t string, {out} {self.kind}")
        return df.select(id_, text).join(scored, F.col(text).eqNullSafe(F.col("_t"))).select(id_, out)
