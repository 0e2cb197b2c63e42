"""Augmentation of code: renamed identifiers, changed white space, added comments; drawn by (seed, id) alone."""

from __future__ import annotations

import keyword
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import nesting
from .sampling import chosen

# Fixed values.
KEPT_NAMES = frozenset({
    "self", "this", "cls", "None", "True", "False",
    "null", "true", "false", "main", "args",
    "int", "str", "float", "bool", "list", "dict",
    "print", "return", "import", "from", "def", "class",
})
COMMENTS = (
    "# Process data", "# Initialize", "# Check condition",
    "# Update state", "# Helper function", "# Main logic",
    "// Process data", "// Initialize", "// Check condition",
    "// Update state", "// Helper function", "// Main logic",
)
RENAME, REFORMAT, COMMENT = 0.5, 0.3, 0.2


def renamed(code: str) -> str:
    """Identifiers as var_0, var_1, ... by sorted name; what can't be parsed stays."""
    import ast

    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last where the parser's stack is too small for the text
        return code
    names = {x for n in ast.walk(tree) for x in ([n.id] if isinstance(n, ast.Name) else [n.arg] if isinstance(n, ast.arg) else [n.name] if isinstance(n, (ast.FunctionDef, ast.ClassDef)) else [])}
    table = {n: f"var_{k}" for k, n in enumerate(sorted(n for n in names if len(n) > 1 and n not in KEPT_NAMES and not keyword.iskeyword(n)))}
    return re.sub(r"\b[^\W\d]\w*\b", lambda m: table.get(m.group(), m.group()), code)


def chance(seed: int, id_: Column, *what: Column) -> Column:
    """A number from 0 to 1 that depends on seed, id and what alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_, *what), F.lit(1_000_000)) / 1_000_000.0


def reformatted(code: Column, id_: Column, seed: int) -> Column:
    """Lines with their indentation doubled (share 0.3) or halved (0.2) where they have one, a blank line before 0.05 of them,
    and 0.05 of the blank ones left out."""

    def line(x: Column, i: Column) -> Column:
        draw = lambda what: chance(seed, id_, F.lit(what), i)
        bare = F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", "")
        n = F.length(x) - F.length(bare)
        to = F.when(draw("indent") < 0.3, 2 * n).when(draw("indent") < 0.5, F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(n)
        own = F.when(bare == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), F.when(n == 0, 0).otherwise(to)), bare))
        return F.filter(F.array(F.when(draw("before") < 0.05, F.lit("")), F.when((own != "") | (draw("drop") >= 0.05), own)), lambda y: y.isNotNull())

    return F.array_join(F.flatten(F.transform(F.split(code, "\n", -1), line)), "\n")


def commented(code: Column, id_: Column, seed: int) -> Column:
    """A comment, as far indented, after 0.08 of the lines."""
    comments = F.array(*map(F.lit, COMMENTS))

    def line(x: Column, i: Column) -> Column:
        draw = lambda what: chance(seed, id_, F.lit(what), i)
        indent = F.regexp_extract(x, r"(?U)^([\s\x1c-\x1f]*)", 1)
        comment = F.concat(F.repeat(F.lit(" "), F.length(indent)), F.get(comments, F.floor(draw("which") * len(COMMENTS)).cast("int")))
        return F.when(draw("comment") < 0.08, F.array(x, comment)).otherwise(F.array(x))

    return F.array_join(F.flatten(F.transform(F.split(code, "\n", -1), line)), "\n")


def augmented(df: DataFrame, seed: int = 42, code: str = "code", id_: str = "ID", language: str | None = None) -> DataFrame:
    """df with code changed by the steps that are drawn for its id, in order: renamed, reformatted, commented; one of them where
    none is. language names a column: texts of the languages that nest are renamed by their tokens, in expressions, and the others
    as Python. Python sees only those of them that are renamed."""

    @F.pandas_udf(StringType())
    def _renamed(text: pd.Series) -> pd.Series:
        return text.map(renamed, na_action="ignore")

    key, kept = F.col(id_), df.columns
    draw = lambda what: chance(seed, key, F.lit(what))
    drawn = F.array(*(draw(what) < share for what, share in (("rename", RENAME), ("reformat", REFORMAT), ("comment", COMMENT))))
    only = F.floor(draw("only") * 3).cast("int")
    steps = df.withColumn("_steps", F.when(F.array_contains(drawn, True), drawn).otherwise(F.array(*(only == k for k in range(3)))))
    nests = F.coalesce(F.col(language).isin(*nesting.LANGUAGES), F.lit(False)) if language else F.lit(False)
    out = steps.withColumn("_renamed", _renamed(F.when(F.get("_steps", F.lit(0)) & ~nests, F.col(code)))).withColumn(code, F.coalesce("_renamed", code))
    if language:
        out = out.withColumn(code, F.when(F.get("_steps", F.lit(0)) & nests, nesting.renamed(F.col(code), F.col(language), sorted(KEPT_NAMES))).otherwise(F.col(code)))
    out = out.withColumn(code, F.when(F.get("_steps", F.lit(1)), reformatted(F.col(code), key, seed)).otherwise(F.col(code)))
    return out.withColumn(code, F.when(F.get("_steps", F.lit(2)), commented(F.col(code), key, seed)).otherwise(F.col(code))).select(*kept)


def with_augmented(df: DataFrame, ratio: float, seed: int = 42, code: str = "code", id_: str = "ID", language: str | None = None) -> DataFrame:
    """df and augmented copies of about that share of its rows, with their id and label."""
    return df.unionByName(augmented(df.where(chosen(id_, ratio, seed)), seed, code, id_, language))
