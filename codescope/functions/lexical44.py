"""44 language-agnostic features of a text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import character_entropy, entropy, found, hits, is_blank, largest, let, lines_of, mean, median, occurrences, ratio, std, strip

# Fixed values.
TOKEN = r"[A-Za-z_]\w*|[0-9]+(?:\.[0-9]+)?|[^\s\w]"
KEYWORDS = (
    "if", "else", "elif", "for", "while", "do", "switch", "case", "break", "continue",
    "return", "try", "catch", "finally", "throw", "class", "def", "function", "func", "fn",
    "import", "from", "include", "package", "namespace", "public", "private", "static", "new",
)
CONTROL = r"\b(if|else|elif|for|while|switch|case|do|try|catch)\b"
LOOP = r"\b(for|while|do)\b"
CONDITION = r"\b(if|elif|else|switch|case)\b"
COMMENT_LINE = r"^\s*(//|#)"
COMMENT_INLINE = r"\S.*(//|#)\s*\S"
#: The same matches with the mark as group 1, and what no match begins in, each line's or blank lines' rest at once, with no group.
COMMENT_LINE_OR_REST = r"^\s*+(//|#|)"
COMMENT_INLINE_OR_REST = r"\S.*(//|#)\s*\S|\S.*+"
FUNCTION = r"\b(?:def|function|func|void|int|string|bool|public|private|static)\s+\w+\s*\("
IMPORT = r"^\s*(?:import|from|#include|using|require|require_once)\b"
DECLARED = r"\b(?:def|function|func|fn)\s+([A-Za-z_]\w*)\s*\("
TEMPLATES = (r"#include\s*<bits/stdc\+\+\.h>", r"using\s+namespace\s+std", r"if\s+__name__\s*==\s*['\"]__main__['\"]", r"public\s+static\s+void\s+main", r"class\s+Solution")
OPERATORS = r"[+\-*/=<>!&|^%]+"

CALLED = r"\b([A-Za-z_]\w*)\s*\("
GROUPS = ("length", "whitespace", "lexical", "comment", "structure", "control", "punctuation", "entropy", "repetition")


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.cast("double").alias(k) for k, c in columns.items()))


def length(code: Column, lines: Column) -> Column:
    return let(F.transform(lines, F.length), lambda n: _struct(total_chars=F.length(code), total_lines=F.size(lines), avg_line_length=mean(n), max_line_length=largest(n), std_line_length=std(n, sample=True), median_line_length=median(n)))


def whitespace(lines: Column) -> Column:
    indents = F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t"))))
    n = F.greatest(F.size(lines), F.lit(1))
    blank = F.size(F.filter(lines, is_blank)) / n
    trailing = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)[\s\x1c-\x1f]\z"))) / n
    return let(indents, lambda i: _struct(avg_indent=mean(i), max_indent=largest(i), std_indent=std(i, sample=True), blank_line_ratio=blank, trailing_ws_ratio=trailing))


def lexical(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens), F.lit(1))
    names = F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z_]"))
    keywords = F.size(F.filter(tokens, lambda t: F.lower(t).isin(*KEYWORDS)))
    numbers = F.size(F.filter(tokens, lambda t: t.rlike("^[0-9]")))

    def of(lengths: Column) -> Column:
        return _struct(total_tokens=F.size(tokens), unique_token_ratio=F.size(F.array_distinct(tokens)) / n, avg_identifier_length=mean(lengths), std_identifier_length=std(lengths, sample=True), number_ratio=numbers / n, identifier_count=F.size(lengths), keyword_count=keywords, keyword_to_identifier_ratio=keywords / F.greatest(F.size(lengths), F.lit(1)))

    return let(F.transform(names, F.length), of)


def comment(code: Column, lines: Column) -> Column:
    n = F.greatest(F.size(lines), F.lit(1))
    marked = lambda pattern, flags="": F.size(F.filter(found(code, pattern, flags, 1), lambda x: x != ""))
    own, inline = marked(COMMENT_LINE_OR_REST, "m"), marked(COMMENT_INLINE_OR_REST)
    multi = hits(code, r"/\*.*?\*/", "s") + hits(code, '""".*?"""', "s") + hits(code, "'''.*?'''", "s")
    return _struct(comment_line_ratio=own / n, inline_comment_ratio=inline / n, multi_line_comment_count=multi, comment_to_code_ratio=(own + multi) / n)


def structure(code: Column) -> Column:
    """Brace depth is a fold over the braces alone: between two of them the depth holds for as many characters as lie there."""
    pieces = F.split(code, r"(?=[{}])")  # every piece but perhaps the first begins with a brace
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("most"), F.lit(0).cast("long").alias("area"))

    def step(a: Column, p: Column) -> Column:
        depth = F.when(F.startswith(p, F.lit("{")), a["d"] + 1).when(F.startswith(p, F.lit("}")), F.greatest(a["d"] - 1, F.lit(0))).otherwise(a["d"])
        return let(depth, lambda d: F.struct(d.alias("d"), F.greatest(a["most"], d).alias("most"), (a["area"] + d.cast("long") * F.length(p)).alias("area")))

    return let(F.aggregate(pieces, zero, step), lambda f: _struct(max_brace_depth=f["most"], avg_brace_depth=ratio(f["area"], F.length(code)), func_count=hits(code, FUNCTION), import_count=hits(code, IMPORT, "m")))


def control(code: Column, tokens: Column) -> Column:
    flow = hits(code, CONTROL, "i")
    calls = found(code, CALLED, "", 1)
    recursive = let(calls, lambda c: F.size(F.filter(found(code, DECLARED, "i", 1), lambda name: F.size(F.filter(c, lambda x: x == name)) > 1)))
    template = sum((hits(code, p, "i") for p in TEMPLATES[1:]), hits(code, TEMPLATES[0], "i"))
    return _struct(control_flow_count=flow, loop_count=hits(code, LOOP, "i"), conditional_count=hits(code, CONDITION, "i"), control_flow_density=flow / F.greatest(F.size(tokens), F.lit(1)), recursive_like_count=recursive, template_like_count=template)


def punctuation(code: Column) -> Column:
    n = F.greatest(F.length(code), F.lit(1))
    both = lambda a, b: (occurrences(code, a) + occurrences(code, b)) / n
    return _struct(brace_ratio=both("{", "}"), bracket_ratio=both("[", "]"), paren_ratio=both("(", ")"), semicolon_density=occurrences(code, ";") / n, comma_density=occurrences(code, ",") / n, operator_diversity=F.size(F.array_distinct(found(code, OPERATORS))))


@F.pandas_udf(DoubleType())
def bigram_entropy(code: pd.Series) -> pd.Series:
    """Shannon entropy in bits of the pairs of neighbouring characters; 0 below two characters."""

    def of(text: str) -> float:
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(at) < 2:
            return 0.0
        c = np.unique(at[:-1] << np.uint64(32) | at[1:], return_counts=True)[1]
        return float(np.log2(c.sum()) - (c * np.log2(c)).sum() / c.sum())

    return code.map(of)


def entropies(code: Column, tokens: Column) -> Column:
    return _struct(char_entropy=character_entropy(code), token_entropy=entropy(tokens), bigram_entropy=bigram_entropy(code))


def repetition(lines: Column) -> Column:
    def of(s: Column) -> Column:
        distinct = F.size(F.array_distinct(s))
        return let(F.array_sort(s), lambda o: _struct(duplicate_line_ratio=F.size(F.array_distinct(F.filter(o, lambda x, i: F.coalesce(F.get(o, i - 1) == x, F.lit(False))))) / F.greatest(F.size(lines), F.lit(1)), unique_line_ratio=distinct / F.greatest(F.size(s), F.lit(1))))

    return let(F.filter(F.transform(lines, strip), lambda x: x != ""), of)


def with_lexical44(df: DataFrame, code: str = "code", groups=GROUPS) -> DataFrame:
    """df with the features of the groups asked for. Lines and tokens are cut once a row."""
    df = df.withColumn("_code", F.coalesce(F.col(code), F.lit("")))
    df = df.withColumn("_lines", lines_of(F.col("_code"))).withColumn("_tokens", found(F.col("_code"), TOKEN))
    c, ls, ts = F.col("_code"), F.col("_lines"), F.col("_tokens")
    made = {
        "length": lambda: length(c, ls), "whitespace": lambda: whitespace(ls), "lexical": lambda: lexical(ts), "comment": lambda: comment(c, ls), "structure": lambda: structure(c),
        "control": lambda: control(c, ts), "punctuation": lambda: punctuation(c), "entropy": lambda: entropies(c, ts), "repetition": lambda: repetition(ls),
    }
    kept = [F.col(f"`{x}`") for x in df.columns if x not in ("_code", "_lines", "_tokens")]
    df = df.select(*kept, *(made[g]().alias(f"_{g}") for g in groups))
    return df.select(*kept, *(f"_{g}.*" for g in groups))
