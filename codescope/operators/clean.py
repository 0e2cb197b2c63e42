"""Cleaning, filters and label algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, strip

# Fixed values.
LANGUAGES = {
    "python": "python", "py": "python", "java": "java", "javascript": "javascript", "js": "javascript", "go": "go", "golang": "go", "c": "c",
    "c++": "cpp", "cpp": "cpp", "c#": "c_sharp", "csharp": "c_sharp", "c_sharp": "c_sharp", "cs": "c_sharp", "php": "php",
}


def require(df: DataFrame, *columns: str) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {lacking}")
    return df


def clean(df: DataFrame, code: str = "code", label: str | None = "label") -> DataFrame:
    """Rows with a text that isn't blank and, if asked, a label."""
    df = df.where(F.col(code).isNotNull() & (strip(F.col(code)) != ""))
    return df.where(F.col(label).isNotNull()) if label else df


def normalised(df: DataFrame, code: str = "code") -> DataFrame:
    return df.withColumn(code, normalise(F.col(code)))


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def binarised(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, (F.col(label) > 0).cast("int"))


def dense_labels(train: DataFrame, label: str = "label") -> DataFrame:
    """(label, idx): the distinct labels numbered from 0. As many rows as labels."""
    return train.select(label).where(F.col(label).isNotNull()).distinct().withColumn("idx", F.row_number().over(Window.orderBy(label)) - 1)


def reindexed(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    return df.join(labels, label).drop(label).withColumnRenamed("idx", label)


def unseen_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct().join(labels, label, "left_anti")


def outside(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """Rows whose label isn't one of 0 to classes - 1."""
    return df.where(F.col(label).isNull() | ~F.col(label).between(0, classes - 1))


def named(df: DataFrame, names: DataFrame, label: str = "label", out: str = "label_name") -> DataFrame:
    """df with the name of its label; the number as text where there is none."""
    d = names.select(F.col("label").alias("_l"), F.col("name").alias("_n"))
    return df.join(d, F.col(label) == F.col("_l"), "left").withColumn(out, F.coalesce("_n", F.col(label).cast("string"))).drop("_l", "_n")


def language_alias(name: Column, default: str | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    known = F.element_at(table, F.lower(F.trim(name)))
    return F.coalesce(known, F.lit(default)) if default else known


def _has(code: Column, *subs: str) -> Column:
    out = F.contains(code, F.lit(subs[0]))
    for s in subs[1:]:
        out = out | F.contains(code, F.lit(s))
    return out


def filled(df: DataFrame, **defaults) -> DataFrame:
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def preview(code: Column, size: int = 150) -> Column:
    return F.replace(F.substring(code, 1, size), F.lit("\n"), F.lit(" "))


def detect_language(code: Column) -> Column:
    """Ordered substring rules over the whole text; Python where none holds."""
    c = F.coalesce(code, F.lit(""))
    rules = [
        (_has(c, "#include") & _has(c, "class", "cout", "::"), "C++"), (_has(c, "#include"), "C"), (_has(c, "System.out"), "Java"), (_has(c, "public class"), "Java"), (_has(c, "<?php"), "PHP"),
        (_has(c, "using System"), "C#"), (_has(c, "func main()"), "Go"), (_has(c, "package main"), "Go"), (_has(c, "console.log"), "JavaScript"), (_has(c, "function "), "JavaScript"),
    ]
    return _case(rules, "Python")


def detect_language_head(code: Column, size: int = 400) -> Column:
    """Rules over the first characters; python where none holds."""
    c = F.substring(F.coalesce(code, F.lit("")), 1, size)
    rules = [(_has(c, "#include"), "cpp"), (_has(c, "System.out", "public class"), "java"), (_has(c, "<?php"), "php"), (_has(c, "using System"), "c_sharp"), (_has(c, "func main()"), "go"), (_has(c, "console.log"), "javascript"), (_has(c, "printf("), "c")]
    return _case(rules, "python")


def _case(rules: list, default: str) -> Column:
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise(default)
