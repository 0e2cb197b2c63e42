"""33 syntax-tree features: from the tree for Python, from brackets and keywords for other languages. Python's own parser cuts a text
into arrays; the features of both kinds are expressions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import entropy, found, hits, let, lines_of, mean, ratio, std, strip, total

NAMES = (
    "max_depth", "avg_depth", "depth_std", "max_breadth", "tree_balance", "node_entropy", "unique_node_ratio", "total_nodes", "if_count", "loop_count", "try_count",
    "cyclomatic_complexity", "nesting_depth", "num_functions", "avg_function_length", "max_function_length", "avg_function_params", "max_function_params", "avg_function_complexity",
    "num_classes", "avg_methods_per_class", "inheritance_depth", "docstring_ratio", "comment_density", "avg_docstring_length", "type_hint_ratio", "return_annotation_ratio",
    "exception_specificity", "try_coverage", "naming_consistency", "avg_identifier_length", "import_count", "import_diversity",
)
DECISIONS = ("If", "For", "While", "And", "Or", "ExceptHandler", "With", "IfExp", "BoolOp")
NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try)
BRANCHES = ("If", "For", "While", "With")


#: What a tree is cut into: for its nodes in preorder the type, depth, number of nesting statements around and place after its subtree;
#: for functions the place, lines and parameters; for classes the place and bases; and what names, imports and handlers hold.
WORDS, PLACES, COUNT = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType()), T.IntegerType()
TREE = T.StructType([T.StructField(name, kind) for name, kind in (
    ("kind", WORDS), ("depth", PLACES), ("nested", PLACES), ("stop", PLACES), ("f_at", PLACES), ("f_lines", PLACES), ("f_params", PLACES), ("c_at", PLACES), ("c_bases", PLACES),
    ("hints", COUNT), ("returns", COUNT), ("docs", PLACES), ("typed", COUNT), ("names", WORDS), ("modules", WORDS),
)])
NO_TREE = [None] * len(TREE)


def cut(code: str | None) -> list:
    """TREE of a text; nulls where it is empty or no Python."""
    try:
        tree = ast.parse(code) if code else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    if tree is None:
        return NO_TREE
    nodes, depth, nested, stop, stack = [], [], [], [], [(tree, 0, 0)]
    while stack:
        node, d, n = stack.pop()
        if node is None:  # the subtree that began at d ends
            stop[d] = len(nodes)
            continue
        stack.append((None, len(nodes), 0))
        nodes.append(node)
        depth.append(d)
        nested.append(n)
        stop.append(0)
        stack += [(c, d + 1, n + isinstance(c, NESTING)) for c in reversed(list(ast.iter_child_nodes(node)))]
    f_at, c_at = ([i for i, n in enumerate(nodes) if isinstance(n, kind)] for kind in (ast.FunctionDef, ast.ClassDef))
    f, c = [nodes[i] for i in f_at], [nodes[i] for i in c_at]
    modules = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    return [
        [type(n).__name__ for n in nodes], depth, nested, stop, f_at, [n.end_lineno - n.lineno + 1 for n in f], [len(n.args.args) for n in f], c_at, [len(n.bases) for n in c],
        sum(a.annotation is not None for n in f for a in n.args.args), sum(n.returns is not None for n in f), [len(s) for n in f + c if (s := ast.get_docstring(n))],
        sum(isinstance(n, ast.ExceptHandler) and n.type is not None for n in nodes), [n.id for n in nodes if isinstance(n, ast.Name)], modules,
    ]


@F.pandas_udf(TREE)
def python_tree(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut(c) for c in code], columns=TREE.names, dtype=object)


def _of(kinds: Column, *names: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k.isin(*names)))


def tree_features(t: Column, code: Column) -> dict[str, Column]:
    """name: column, from a struct TREE that isn't null."""
    kinds, depth, lines = t["kind"], t["depth"], lines_of(code)
    n, functions, classes = F.size(kinds), F.size(t["f_at"]), F.size(t["c_at"])
    inside = lambda at, *names: F.transform(at, lambda i: _of(F.slice(kinds, i + 1, F.get(t["stop"], i) - i), *names))
    tries = F.filter(F.transform(kinds, lambda k, i: F.when(k == "Try", F.get(t["stop"], i) - i)), lambda x: x.isNotNull())
    handlers, imports = _of(kinds, "ExceptHandler"), _of(kinds, "Import", "ImportFrom")
    snake = F.size(F.filter(t["names"], lambda x: F.contains(x, F.lit("_")) & x.rlike(r"\p{IsLowercase}") & ~x.rlike(r"[\p{IsUppercase}\p{Lt}]")))
    camel = F.size(F.filter(t["names"], lambda x: ~F.contains(x, F.lit("_")) & x.rlike(r"\p{IsUppercase}")))
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    return {
        "max_depth": most(depth), "avg_depth": mean(depth), "depth_std": std(depth), "max_breadth": _breadth(depth), "tree_balance": ratio(mean(depth), most(depth)),
        "node_entropy": entropy(kinds), "unique_node_ratio": F.size(F.array_distinct(kinds)) / n, "total_nodes": n, "if_count": _of(kinds, "If"), "loop_count": _of(kinds, "For", "While"), "try_count": _of(kinds, "Try"),
        "cyclomatic_complexity": 1 + _of(kinds, *DECISIONS), "nesting_depth": most(t["nested"]), "num_functions": functions, "avg_function_length": mean(t["f_lines"]), "max_function_length": most(t["f_lines"]),
        "avg_function_params": mean(t["f_params"]), "max_function_params": most(t["f_params"]), "avg_function_complexity": mean(inside(t["f_at"], *BRANCHES)),
        "num_classes": classes, "avg_methods_per_class": mean(inside(t["c_at"], "FunctionDef")), "inheritance_depth": most(t["c_bases"]),
        "docstring_ratio": ratio(F.size(t["docs"]), functions + classes), "comment_density": F.size(F.filter(lines, lambda x: F.startswith(strip(x), F.lit("#")))) / F.size(lines), "avg_docstring_length": mean(t["docs"]),
        "type_hint_ratio": ratio(t["hints"], total(t["f_params"])), "return_annotation_ratio": ratio(t["returns"], functions),
        "exception_specificity": F.when(handlers == 0, 0.5).otherwise(t["typed"] / handlers), "try_coverage": total(tries) / n,
        "naming_consistency": ratio(F.greatest(snake, camel), F.size(t["names"])), "avg_identifier_length": mean(F.transform(t["names"], F.length)),
        "import_count": imports, "import_diversity": ratio(F.size(F.array_distinct(t["modules"])), imports),
    }


# Fixed values of the features from brackets and keywords.
KEYWORD = r"\b(if|else|for|while|switch|case|try|catch|finally|class|function|def|return|break|continue)\b"
FUNCTION = r"\b\w+\s+\w+\s*\([^)]*\)\s*\{"
NEUTRAL = {"node_entropy": 3.0, "avg_docstring_length": 50.0, "return_annotation_ratio": 0.3, "import_diversity": 0.7}
GENERIC_ERRORS = ("Exception", "Error", "e")


DEPTHS = T.StructType([T.StructField("deepest", COUNT), T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType()), T.StructField("widest", COUNT)])


@F.pandas_udf(DEPTHS)
def bracket_depths(brackets: pd.Series) -> pd.DataFrame:
    """Of the depths at the opening brackets of a text of brackets: the largest, mean, deviation, and how many the fullest level has.
    Depth never falls below 0, so it is the sum of steps less the lowest sum before, in time with the length."""
    import numpy as np

    def of(text: str | None) -> tuple:
        if not text:
            return 0, 0.0, 0.0, 0
        opens = np.isin(np.frombuffer(text.encode(), np.uint8), np.frombuffer(b"{[(", np.uint8))
        sums = np.cumsum(np.where(opens, 1, -1))
        d = (sums - np.minimum(np.minimum.accumulate(sums), 0))[opens]
        return (int(d.max()), float(d.mean()), float(d.std()), int(np.bincount(d).max())) if len(d) else (0, 0.0, 0.0, 0)

    return pd.DataFrame([of(t) for t in brackets], columns=DEPTHS.names)


def _breadth(depths: Column) -> Column:
    """The most openers on one level."""
    return let(F.array_sort(depths), lambda s: F.coalesce(F.array_max(F.transform(F.array_distinct(s), lambda d: F.size(F.filter(s, lambda x: x == d)))), F.lit(0)))


def bracket_counts(code: Column) -> dict[str, Column]:
    """What the features of any language are made from, each of which several of them need."""
    pieces = F.split(code, f"(?dU)(?={FUNCTION})")
    return {
        "lines": F.size(lines_of(code)), "ifs": hits(code, r"\bif\s*\("), "loops": hits(code, r"\b(for|while)\s*\("), "tries": hits(code, r"\btry\s*[{\(]"), "functions": hits(code, FUNCTION), "classes": hits(code, r"\bclass\s+\w+"),
        # the lookahead also holds inside the first word of a match; a piece is a function where a match begins at a word's start
        "spans": F.transform(F.filter(pieces, lambda p: p.rlike(rf"(?dU)\A{FUNCTION}")), lambda p: F.size(lines_of(p))),
        "params": F.transform(F.filter(found(code, r"\(([^)]*)\)", "", 1), lambda x: strip(x) != ""), lambda x: F.size(F.filter(F.split(x, ",", -1), lambda y: strip(y) != ""))),
        "comments": hits(code, "//.*$", "m") + hits(code, r"/\*.*?\*/", "s"), "words": found(code, r"\b[a-zA-Z_]\w+\b"), "keywords": found(code, KEYWORD), "caught": found(code, r"catch\s*\(\s*(\w+)", "", 1),
    }


def bracket_features(code: Column, depths: Column, of: dict[str, Column]) -> dict[str, Column]:
    """name: column, for any language, of a text, its bracket_depths() and columns of its bracket_counts()."""
    lines, ifs, loops, tries, functions, classes, spans, params, comments, words, keywords, caught = (of[k] for k in ("lines", "ifs", "loops", "tries", "functions", "classes", "spans", "params", "comments", "words", "keywords", "caught"))
    one = F.greatest(functions, F.lit(1))
    deepest = depths["deepest"]
    return {
        "max_depth": deepest, "avg_depth": depths["mean"], "depth_std": depths["sd"], "max_breadth": depths["widest"], "tree_balance": ratio(depths["mean"], deepest),
        "node_entropy": F.lit(NEUTRAL["node_entropy"]), "unique_node_ratio": let(keywords, lambda k: ratio(F.size(F.array_distinct(k)), F.size(k))), "total_nodes": 2 * F.size(keywords), "if_count": ifs, "loop_count": loops, "try_count": tries,
        "cyclomatic_complexity": 1 + ifs + loops, "nesting_depth": deepest, "num_functions": functions, "avg_function_length": mean(spans), "max_function_length": F.coalesce(F.array_max(spans), F.lit(0)),
        "avg_function_params": mean(params), "max_function_params": F.coalesce(F.array_max(params), F.lit(0)), "avg_function_complexity": (1 + ifs + loops) / one,
        "num_classes": classes, "avg_methods_per_class": ratio(functions, classes), "inheritance_depth": hits(code, "extends|implements|:") / F.greatest(classes, F.lit(1)),
        "docstring_ratio": comments / one, "comment_density": comments / lines, "avg_docstring_length": F.lit(NEUTRAL["avg_docstring_length"]),
        "type_hint_ratio": hits(code, r":\s*\w+") / F.greatest(functions * 2, F.lit(1)), "return_annotation_ratio": F.lit(NEUTRAL["return_annotation_ratio"]),
        "exception_specificity": let(caught, lambda c: F.when(F.size(c) == 0, F.lit(0.5)).otherwise(F.size(F.filter(c, lambda x: ~x.isin(*GENERIC_ERRORS))) / F.size(c))), "try_coverage": tries / one,
        "naming_consistency": let(words, lambda w: ratio(F.greatest(F.size(F.filter(w, lambda x: F.contains(x, F.lit("_")))), F.size(F.filter(w, lambda x: x.rlike(r"\p{Lu}")))), F.size(w))), "avg_identifier_length": let(F.transform(words, F.length), mean),
        "import_count": hits(code, r"\b(import|include|using|require)\s+"), "import_diversity": F.lit(NEUTRAL["import_diversity"]),
    }


def with_ast33(df: DataFrame, code: str = "code", language: str = "language", compat_python_only: bool = False) -> DataFrame:
    """df with the features: of the tree where language is Python, of brackets elsewhere; compat_python_only parses all as Python."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    python = F.lit(True) if compat_python_only else F.coalesce(F.lower(F.trim(F.col(language))).isin("python", "py"), F.lit(False))
    df = df.withColumn("_code", F.coalesce(F.col(code), F.lit(""))).withColumn("_python", python).withColumn("_tree", python_tree(F.when(F.col("_python"), F.col("_code"))))
    zeros = F.array_repeat(F.lit(0.0), len(NAMES))
    listed = lambda made: F.array(*(made[k].cast("double") for k in NAMES))
    own = F.when(F.col("_tree.kind").isNull(), zeros).otherwise(listed(tree_features(F.col("_tree"), F.col("_code"))))
    if not compat_python_only:
        counts = bracket_counts(F.when(~F.col("_python"), F.col("_code")))
        df = df.withColumns({f"_{k}_": c for k, c in counts.items()}).withColumn("_depths", bracket_depths(F.when(~F.col("_python"), F.regexp_replace("_code", r"[^{}\[\]()]+", ""))))
    other = own if compat_python_only else F.when(F.col("_code") == "", zeros).otherwise(listed(bracket_features(F.col("_code"), F.col("_depths"), {k: F.col(f"_{k}_") for k in counts})))
    df = df.withColumn("_f", F.when(F.col("_python"), own).otherwise(other))
    return df.select(*kept, *(F.get("_f", F.lit(k)).alias(name) for k, name in enumerate(NAMES)))
