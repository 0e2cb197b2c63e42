"""12 stylometric features and 4 token features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import begins, entropy, found, hits, is_blank, let, lines_of, mean, occurrences, ratio, std, strip

# Fixed values.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "NOTE", "BUG", "OPTIMIZE", "REFACTOR", "DEPRECATE", "TEMP")
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await",
    "break", "class", "continue", "def", "del", "elif", "else", "except",
    "finally", "for", "from", "global", "if", "import", "in", "is",
    "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try",
    "while", "with", "yield",
)
IDENTIFIER = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
OPERATORS = (" = ", " == ", " + ", " - ", " * ", " / ")

NAMES = (
    "identifier_length", "identifier_entropy", "identifier_naming", "whitespace_entropy", "indentation_consistency", "comment_line_density", "comment_length_variation",
    "line_length_variation", "token_diversity", "human_markers", "code_to_comment", "formatting_consistency",
)


def identifiers(code: Column) -> Column:
    """Names outside quoted strings and # comments, without keywords."""
    bare = F.regexp_replace(F.regexp_replace(code, "(?d)[\"'].*?[\"']", ""), "(?dm)#.*$", "")
    return F.filter(let(bare, lambda t: found(t, IDENTIFIER)), lambda x: ~x.isin(*PYTHON_KEYWORDS))


def _variation(lengths: Column) -> Column:
    return F.when(F.size(lengths) < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), ratio(std(lengths), mean(lengths))))


def _blank(line: Column) -> Column:
    return is_blank(line)


def _code_to_comment(lines: Column) -> Column:
    """A line with a triple quote opens or closes a block and is a comment, as is all inside; then # lines; then code."""
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("code"), F.lit(0).alias("comment"))

    def step(a: Column, line: Column) -> Column:
        quote = F.contains(line, F.lit('"""')) | F.contains(line, F.lit("'''"))
        own = quote | a["open"] | begins(line, "#")
        return F.struct((a["open"] != quote).alias("open"), (a["code"] + (~own & ~_blank(line)).cast("int")).alias("code"), (a["comment"] + own.cast("int")).alias("comment"))

    return let(F.aggregate(lines, start, step), lambda a: F.when(a["comment"] == 0, F.lit(1.0)).otherwise(1.0 - F.least(F.lit(1.0), a["code"] / a["comment"] / 20.0)))


def _formatting(code: Column) -> Column:
    """The mean of the checks that apply: even numbers of blank lines before definitions, spaced operators, one style of quotes.
    A definition is found from the first line break before it on, so the blank lines before it belong to it, none are left to
    count, and the numbers are even wherever there are two definitions."""
    spaced = sum((occurrences(code, o) for o in OPERATORS[1:]), occurrences(code, OPERATORS[0]))
    bare = sum((occurrences(code, o.strip()) for o in OPERATORS[1:]), occurrences(code, OPERATORS[0].strip()))
    single = occurrences(code, "'") - occurrences(code, "\\'")
    double = occurrences(code, '"') - occurrences(code, '\\"')
    checks = F.array(
        F.when(hits(code, r"\n[\s\x1c-\x1f]*def[\s\x1c-\x1f]+\w+") > 1, 1.0),
        F.when(bare > 0, F.least(F.lit(1.0), spaced / bare)),
        F.when(single + double > 0, F.greatest(single, double) / (single + double)),
    )
    return let(F.array_compact(checks), lambda c: F.when(F.size(c) == 0, F.lit(0.5)).otherwise(mean(c)))


@F.pandas_udf(T.DoubleType())
def token_diversity(code: pd.Series) -> pd.Series:
    """Distinct over all tokens of Python's tokenizer; of words between white space where that fails."""
    import io
    import tokenize

    def of(text: str) -> float:
        try:
            tokens = [t.string for t in tokenize.generate_tokens(io.StringIO(text or "").readline) if t.string.strip()]
        except Exception:  # noqa: BLE001  any failure of the tokenizer means the text isn't Python
            tokens = (text or "").split()
        return len(set(tokens)) / len(tokens) if tokens else 0.0

    return code.map(of)


def _markers(code: Column) -> Column:
    """How many markers a text has. Upper-cased once; only those that it has are counted."""
    return let(F.upper(code), lambda u: sum((F.when(F.contains(u, F.lit(m)), occurrences(u, m)).otherwise(F.lit(0)) for m in MARKERS[1:]), F.when(F.contains(u, F.lit(MARKERS[0])), occurrences(u, MARKERS[0])).otherwise(F.lit(0))))


def stylometric(name: str, code: Column, lines: Column, full: Column, names: Column, diversity: Column) -> Column:
    """One feature of a text that isn't blank, its lines, the lengths of those that aren't blank, its identifiers and token_diversity()."""
    if name == "identifier_length":
        return let(F.transform(names, F.length), lambda n: F.least(F.lit(1.0), mean(n) / 20.0))
    if name == "identifier_entropy":
        return F.least(F.lit(1.0), entropy(F.transform(names, F.length)) / 5.0)
    if name == "identifier_naming":
        return ratio(F.greatest(F.size(F.filter(names, lambda i: i.rlike("[a-z][A-Z]"))), F.size(F.filter(names, lambda i: i.rlike("[a-z]_[a-z]")))), F.size(names))
    if name == "whitespace_entropy":
        return F.least(F.lit(1.0), entropy(found(code, r"\s+")) / 4.0)
    if name == "indentation_consistency":
        return F.lit(1.0)
    if name == "comment_line_density":
        docs = F.concat(found(code, '""".*?"""', "s"), found(code, "'''.*?'''", "s"))
        own = F.size(F.filter(lines, lambda x: begins(x, "#"))) + F.aggregate(docs, F.lit(0), lambda a, d: a + F.size(lines_of(d)))
        return F.least(F.lit(1.0), ratio(own, F.size(full)))
    if name == "comment_length_variation":
        return let(F.transform(found(code, "#.*$", "m"), lambda c: F.length(strip(F.regexp_replace(c, "^#+|#+$", "")))), _variation)
    if name == "line_length_variation":
        return _variation(full)
    if name == "token_diversity":
        return diversity
    if name == "human_markers":
        return F.least(F.lit(1.0), ratio(_markers(code), F.size(full) * 0.1))
    if name == "code_to_comment":
        return _code_to_comment(lines)
    if name == "formatting_consistency":
        return _formatting(code)
    raise KeyError(name)


def with_stylometric12(df: DataFrame, code: str = "code", names=NAMES) -> DataFrame:
    """df with the features asked for; blank texts have zeros. Lines and identifiers are cut once a row."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumn("_code", F.coalesce(F.col(code), F.lit("")))
    df = df.withColumn("_diversity", token_diversity(F.col("_code")) if "token_diversity" in names else F.lit(None).cast("double"))  # before the arrays, which else go by it row by row
    df = df.withColumns({"_blank": is_blank(F.col("_code")), "_lines": lines_of(F.col("_code")), "_names": identifiers(F.col("_code"))})
    df = df.withColumn("_full", F.transform(F.filter(F.col("_lines"), lambda x: ~_blank(x)), F.length))
    return df.select(*kept, *(F.when(F.col("_blank"), F.lit(0.0)).otherwise(stylometric(n, *map(F.col, ("_code", "_lines", "_full", "_names", "_diversity")))).alias(n) for n in names))


def with_token4(df: DataFrame, code: str = "code") -> DataFrame:
    """df with four token features: name length, comment lines, indent variance, distinct operators."""
    c = F.coalesce(F.col(code), F.lit(""))
    lines = lines_of(c)
    names = F.transform(found(c, IDENTIFIER), F.length)
    own = F.filter(lines, lambda x: begins(x, r"//|#|/\*|\*"))
    indents = F.transform(F.filter(lines, lambda x: ~_blank(x)), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", "")))
    return df.withColumns({
        "token_name_length": let(names, lambda n: mean(n) / 20.0),
        "token_comment_ratio": F.size(own) / F.greatest(F.size(lines), F.lit(1)),
        "token_indent_variance": let(indents, lambda i: F.least(F.lit(1.0), let(std(i), lambda s: s * s) / 100.0)),
        "token_operators": F.least(F.lit(1.0), F.size(F.array_distinct(found(c, r"[+\-*/%=<>!&|^~]+"))) / 20.0),
    })


