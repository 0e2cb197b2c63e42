"""Submission tables and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(ids: DataFrame, predictions: DataFrame, fallback: int | None = None, id_: str = "ID", pred: str = "prediction") -> DataFrame:
    """(ID, label) for every id; ids without prediction get the fallback, or the majority of the predictions."""
    from .profile import majority

    p = predictions.select(F.col(id_), F.col(pred).cast("int").alias("_p"))
    out = ids.select(id_).join(p, id_, "left")
    if fallback is not None:
        return out.select(F.col(id_).cast("long").alias(id_), F.coalesce("_p", F.lit(fallback)).alias("label"))
    return out.crossJoin(F.broadcast(majority(p, "_p"))).select(F.col(id_).cast("long").alias(id_), F.coalesce("_p", "majority").cast("int").alias("label"))


def checks(df: DataFrame, test: DataFrame, classes: int, expected: int | None = None) -> DataFrame:
    """(check, violations): columns, duplicate_ids, null_labels, missing_ids, extra_ids, row_count, invalid_labels."""
    spark = df.sparkSession
    good = list(df.columns) == ["ID", "label"]
    one = spark.range(1)
    rows = [one.select(F.lit("columns").alias("check"), F.lit(0 if good else 1).cast("long").alias("violations"))]
    if not good:
        return rows[0]
    count = lambda name, d: d.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    rows += [
        count("duplicate_ids", df.groupBy("ID").count().where("count > 1")), count("null_labels", df.where("label IS NULL")), count("missing_ids", test.select("ID").distinct().join(df, "ID", "left_anti")),
        count("extra_ids", df.join(test.select("ID").distinct(), "ID", "left_anti")), count("invalid_labels", df.where(f"label IS NOT NULL AND NOT label BETWEEN 0 AND {classes - 1}")),
    ]
    n = df.agg(F.count("*").alias("n"))
    want = F.lit(expected) if expected is not None else None
    other = n.select(F.lit("row_count").alias("check"), F.abs(F.col("n") - want).alias("violations")) if want is not None else n.crossJoin(test.agg(F.count("*").alias("m"))).select(F.lit("row_count").alias("check"), F.abs(F.col("n") - F.col("m")).alias("violations"))
    rows.append(other)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def validate(df: DataFrame, test: DataFrame, classes: int, expected: int | None = None) -> None:
    bad = [f"{r['check']}: {r['violations']}" for r in checks(df, test, classes, expected).where("violations > 0").collect()]
    if bad:
        raise ValueError("; ".join(bad))
