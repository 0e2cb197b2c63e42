"""Features of code, with SQL. The tables have no code, so it is derived from them: a customer's orders are the parts of one Python
script and of one class with methods. The scripts have what the features look for: definitions, comments, blocks of quotes, names of
several styles, blank lines; the classes have brackets, branches, loops and handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ast33, lexical44, signature57, stylometric12
from ..operators import clean, graph, profile
from ..sources.io import materialised
from .queries import FOLD, _lines, _signature_sql, _sql_count, folded, query, rounded, samples, table, tree

#: What an order is in a script and in a class, by o_orderkey % 6; K stands for its key, S for its status, P for its priority.
SCRIPT = (
    "total = total + K",
    "# step K: add the order\n",
    '\n\ndef add_order_K(value, taxRate):\n    """Return the S order."""\n    return value+K\n',
    'if total > K:\n\tprint(f"{total}")  # TODO: check \'K\'',
    "maxCost_K = 'a' + \"S\" ",
    "'''\nnotes of P\n'''",
)
CLASS = (
    "total = total + K;",
    'if (order_K > 3) { emitOrder("S", [K, 2]); }',
    "for (i = 0; i < K; i++) { total += price[i]; } // closes }\n",
    "/* ( { P */ note('(');\n",
    "try { send(K); } catch (Exception e) { fail_now(K, S); }",
    "}\nint step_K(int a, long b_c) {\n return a;\n",
)
IMPORTS = "import os\nfrom typing import List\n\n"
HEAD, TAIL = "import a.b;\nclass Customer extends Base {\nint spend(int total, long tax) {\n", "}\n}\n"


def _texts(spark, sf, forms, head: str = "", tail: str = "") -> DataFrame:
    """(ID, code): a text a customer that has orders."""
    filled = lambda s: F.replace(F.replace(F.replace(F.lit(s), F.lit("K"), F.col("o_orderkey").cast("string")), F.lit("S"), F.col("o_orderstatus")), F.lit("P"), F.col("o_orderpriority"))
    part = F.coalesce(*(F.when(F.col("o_orderkey") % len(forms) == k, filled(s)) for k, s in enumerate(forms)))
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ID")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("s")))).alias("ss"))
    return by.select("ID", F.concat(F.lit(head), F.array_join(F.transform("ss", lambda x: x["s"]), "\n"), F.lit(tail)).alias("code"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _texts_sql(forms, head: str = "", tail: str = "") -> str:
    part = " ".join(f"WHEN {k} THEN {_sql_text(s)}" for k, s in enumerate(forms))
    filled = f"replace(replace(replace(CASE o_orderkey % {len(forms)} {part} END, 'K', o_orderkey::VARCHAR), 'S', o_orderstatus), 'P', o_orderpriority)"
    return f"f AS (SELECT o_custkey AS ID, {_sql_text(head)} || string_agg({filled}, chr(10) ORDER BY o_orderkey) || {_sql_text(tail)} AS code FROM orders GROUP BY o_custkey)"


def scripts(spark, sf) -> DataFrame:
    return _texts(spark, sf, SCRIPT, IMPORTS)


def classes(spark, sf) -> DataFrame:
    return _texts(spark, sf, CLASS, HEAD, TAIL)


# ---- stylometric features ----

_SCRIPTS = _texts_sql(SCRIPT, IMPORTS)
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in stylometric12.PYTHON_KEYWORDS) + "]"


def _times(sub: str) -> str:
    return f"((length(code) - length(replace(code, {_sql_text(sub)}, ''))) // {len(sub)})"


def _variation(lengths: str) -> str:
    return f"CASE WHEN len({lengths}) < 2 OR list_avg({lengths}) = 0 THEN 0.0 ELSE least(1.0, list_stddev_pop({lengths}) / list_avg({lengths})) END"


_SPACED, _BARE = (" + ".join(_times(o if spaced else o.strip()) for o in stylometric12.OPERATORS) for spaced in (True, False))
_STYLE = {
    "identifier_length": "CASE WHEN len(ids) = 0 THEN 0 ELSE least(1.0, list_avg(sizes) / 20) END",
    "identifier_entropy": "least(1.0, coalesce(list_entropy(sizes), 0) / 5)",
    "identifier_naming": "CASE WHEN len(ids) = 0 THEN 0 ELSE greatest(len(list_filter(ids, lambda x: regexp_matches(x, '[a-z][A-Z]'))), len(list_filter(ids, lambda x: regexp_matches(x, '[a-z]_[a-z]')))) / len(ids) END",
    "whitespace_entropy": "least(1.0, coalesce(list_entropy(regexp_extract_all(code, '\\s+')), 0) / 4)",
    "indentation_consistency": "1.0",
    "comment_line_density": "CASE WHEN len(full_lines) = 0 THEN 0 ELSE least(1.0, (len(list_filter(ls, lambda x: starts_with(x, '#'))) + coalesce(list_sum(list_transform(docs, lambda x: len(string_split(x, chr(10))))), 0)) / len(full_lines)) END",
    "comment_length_variation": _variation("notes"),
    "line_length_variation": _variation("widths"),
    "code_to_comment": "CASE WHEN own = 0 THEN 1.0 ELSE 1.0 - least(1.0, rest / own / 20.0) END",
    "formatting_consistency": "coalesce(list_avg(list_filter([CASE WHEN defs > 1 THEN 1.0 END, CASE WHEN bare > 0 THEN least(1.0, spaced / bare) END, CASE WHEN one + two > 0 THEN greatest(one, two) / (one + two) END], lambda x: x IS NOT NULL)), 0.5)",
}


def _style_sql(texts: str, id_: str) -> str:
    cut = "regexp_extract_all(regexp_replace(regexp_replace(code, '(?-s)[\"''].*?[\"'']', '', 'g'), '(?m-s)#.*$', '', 'g'), '" + stylometric12.IDENTIFIER + "')"
    values = ", ".join(f"CASE WHEN trim(code, {_STRIP}) = '' THEN 0.0 ELSE round(({v})::DOUBLE, 6) END AS {n}" for n, v in _STYLE.items())
    return f"""WITH {texts}, u AS (SELECT {id_}, unnest({_lines}) AS line, unnest(range(len({_lines}))) AS pos FROM f),
y AS (SELECT *, trim(line, {_STRIP}) AS bare, contains(line, '\"\"\"') OR contains(line, '''''''') AS quote FROM u),
o AS (SELECT *, coalesce(sum(quote::INTEGER) OVER (PARTITION BY {id_} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM y),
c AS (SELECT {id_}, count(*) FILTER (quote OR inside OR starts_with(bare, '#')) AS own, count(*) FILTER (NOT (quote OR inside OR starts_with(bare, '#')) AND bare <> '') AS rest FROM o GROUP BY {id_}),
i AS (SELECT {id_}, code, list_filter({cut}, lambda x: NOT list_contains({_KEYWORDS}, x)) AS ids, list_transform({_lines}, lambda x: trim(x, {_STRIP})) AS ls, list_filter({_lines}, lambda x: trim(x, {_STRIP}) <> '') AS full_lines,
regexp_extract_all(code, '(?s)\"\"\".*?\"\"\"') || regexp_extract_all(code, '(?s)''''''.*?''''''') AS docs, list_transform(regexp_extract_all(code, '(?m-s)#.*$'), lambda x: length(trim(trim(x, '#'), {_STRIP}))) AS notes,
{_SPACED} AS spaced, {_BARE} AS bare, {_times("'")} - {_times(chr(92) + "'")} AS one, {_times('"')} - {_times(chr(92) + '"')} AS two, {_sql_count(r"\n\s*def\s+\w+")} AS defs FROM f),
e AS (SELECT *, list_transform(ids, lambda x: length(x)) AS sizes, list_transform(full_lines, lambda x: length(x)) AS widths FROM i JOIN c USING ({id_}))
SELECT {id_}, {values} FROM e"""


@query(_style_sql(_SCRIPTS, "ID"))
def script_style(spark, sf):
    """Ten stylometric features of every script."""
    return rounded(stylometric12.with_stylometric12(scripts(spark, sf), "code", tuple(_STYLE)).drop("code"))


@query(_style_sql(FOLD, "doc_id"))
def document_style(spark, sf):
    """The same features of every document."""
    return rounded(stylometric12.with_stylometric12(folded(spark, sf), "code", tuple(_STYLE)).drop("code"))


# ---- signatures ----

_GAPS = f"regexp_replace(code, '(?m-s){signature57.DEF_LINE}', chr(1) || '\\0', 'g')"
_GAP = f"list_transform(string_split({_GAPS}, chr(1))[2:-2], lambda x: length(x))"
_UNIFORM = f"CASE WHEN code = '' THEN 0.0 WHEN {_sql_count(signature57.DEF_LINE, 'm')} < 2 THEN 0.5 WHEN len({_GAP}) < 2 THEN 1.0 ELSE round(1.0 - least(list_stddev_pop({_GAP}) / 1000, 1.0), 6) END::DOUBLE AS ai_uniform_complexity"


def _scores_sql(texts: str, id_: str) -> str:
    names = {f: [n for n in signature57.NAMES if n.startswith(f + "_")] for f in signature57.FAMILIES}
    raw = ", ".join((_UNIFORM if n == "ai_uniform_complexity" else _signature_sql(n)).replace("round(", "(").replace(", 6)", ")") for ns in names.values() for n in ns)
    means = ", ".join(f"round(({' + '.join(ns)}) / {len(ns)}, 9) AS score_{'ai_generic' if f == 'ai' else f}" for f, ns in names.items())
    return f"WITH {texts}, w AS (SELECT {id_}, {raw} FROM f) SELECT {id_}, round(ai_uniform_complexity, 9) AS ai_uniform_complexity, {means} FROM w"


def _scored(df: DataFrame, id_: str) -> DataFrame:
    return rounded(signature57.family_scores(signature57.with_signature57(df)).select(id_, "ai_uniform_complexity", *(f"score_{'ai_generic' if f == 'ai' else f}" for f in signature57.FAMILIES)), 9)


@query(_scores_sql(_SCRIPTS, "ID"))
def script_signatures(spark, sf):
    """Family scores of every script, and how alike its definitions are in length."""
    return _scored(scripts(spark, sf), "ID")


@query(_scores_sql(FOLD, "doc_id"))
def signature_scores(spark, sf):
    """The same of every document."""
    return _scored(folded(spark, sf), "doc_id")


# ---- syntax features from brackets ----

_N = {
    "ifs": _sql_count(r"\bif\s*\("), "loops": _sql_count(r"\b(for|while)\s*\("), "tries": _sql_count(r"\btry\s*[{\(]"), "functions": _sql_count(ast33.FUNCTION), "classes": _sql_count(r"\bclass\s+\w+"),
    "comments": f"{_sql_count('//.*$', 'm')} + {_sql_count(r'/\*.*?\*/', 's')}", "hints": _sql_count(r":\s*\w+"), "bases": _sql_count("extends|implements|:"), "imports": _sql_count(r"\b(import|include|using|require)\s+"),
    "n_lines": f"len({_lines})", "words": r"regexp_extract_all(code, '\b[a-zA-Z_]\w+\b')", "keywords": f"regexp_extract_all(code, '{ast33.KEYWORD}')", "caught": r"regexp_extract_all(code, 'catch\s*\(\s*(\w+)', 1)",
    "spans": f"list_transform(string_split(regexp_replace(code, '{ast33.FUNCTION}', chr(1) || '\\0', 'g'), chr(1))[2:], lambda x: len(string_split(x, chr(10))))",
    "params": r"list_transform(list_filter(regexp_extract_all(code, '\(([^)]*)\)', 1), lambda x: trim(x) <> ''), lambda x: len(list_filter(string_split(x, ','), lambda y: trim(y) <> '')))",
}
_BRACKETS = {
    "max_depth": "coalesce(deepest, 0)", "avg_depth": "coalesce(mean_depth, 0)", "depth_std": "coalesce(sd, 0)", "max_breadth": "coalesce(widest, 0)", "tree_balance": "coalesce(mean_depth / deepest, 0)", "node_entropy": "3.0",
    "unique_node_ratio": "CASE WHEN len(keywords) = 0 THEN 0 ELSE len(list_distinct(keywords)) / len(keywords) END", "total_nodes": "2 * len(keywords)", "if_count": "ifs", "loop_count": "loops", "try_count": "tries",
    "cyclomatic_complexity": "1 + ifs + loops", "nesting_depth": "coalesce(deepest, 0)", "num_functions": "functions", "avg_function_length": "coalesce(list_avg(spans), 0)", "max_function_length": "coalesce(list_max(spans), 0)",
    "avg_function_params": "coalesce(list_avg(params), 0)", "max_function_params": "coalesce(list_max(params), 0)", "avg_function_complexity": "(1 + ifs + loops) / greatest(functions, 1)", "num_classes": "classes",
    "avg_methods_per_class": "CASE WHEN classes = 0 THEN 0 ELSE functions / classes END", "inheritance_depth": "bases / greatest(classes, 1)", "docstring_ratio": "comments / greatest(functions, 1)", "comment_density": "comments / n_lines",
    "avg_docstring_length": "50.0", "type_hint_ratio": "hints / greatest(functions * 2, 1)", "return_annotation_ratio": "0.3", "try_coverage": "tries / greatest(functions, 1)", "import_count": "imports", "import_diversity": "0.7",
    "exception_specificity": "CASE WHEN len(caught) = 0 THEN 0.5 ELSE len(list_filter(caught, lambda x: x NOT IN ('Exception', 'Error', 'e'))) / len(caught) END",
    "naming_consistency": "CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(list_filter(words, lambda x: contains(x, '_'))), len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]')))) / len(words) END",
    "avg_identifier_length": "coalesce(list_avg(list_transform(words, lambda x: length(x))), 0)",
}


def _brackets_sql(texts: str, id_: str) -> str:
    return f"""WITH {texts}, n AS (SELECT {id_}, code, {", ".join(f"{v} AS {k}" for k, v in _N.items())} FROM f),
b AS (SELECT {id_}, unnest(string_split(regexp_replace(code, '[^{{}}\\[\\]()]+', '', 'g'), '')) AS c, unnest(range(length(regexp_replace(code, '[^{{}}\\[\\]()]+', '', 'g')))) AS pos FROM f),
s AS (SELECT *, sum(CASE WHEN c IN ('(', '[', '{{') THEN 1 ELSE -1 END) OVER (PARTITION BY {id_} ORDER BY pos) AS s FROM b WHERE c <> ''),
d AS (SELECT {id_}, c, s - least(0, min(s) OVER (PARTITION BY {id_} ORDER BY pos)) AS d FROM s),
g AS (SELECT {id_}, d, count(*) AS n FROM d WHERE c IN ('(', '[', '{{') GROUP BY ALL),
t AS (SELECT {id_}, max(d) AS deepest, avg(d) AS mean_depth, stddev_pop(d) AS sd FROM d WHERE c IN ('(', '[', '{{') GROUP BY {id_}), w AS (SELECT {id_}, max(n) AS widest FROM g GROUP BY {id_})
SELECT {id_}, {", ".join(f"CASE WHEN code = '' THEN 0.0 ELSE round(({v})::DOUBLE, 6) END AS {n}" for n, v in ((n, _BRACKETS[n]) for n in ast33.NAMES))} FROM n LEFT JOIN t USING ({id_}) LEFT JOIN w USING ({id_})"""


@query(_brackets_sql(_texts_sql(CLASS, HEAD, TAIL), "ID"))
def class_brackets(spark, sf):
    """The 33 syntax features of every class, from its brackets and keywords."""
    return rounded(ast33.with_ast33(classes(spark, sf).withColumn("language", F.lit("java"))).drop("code", "language"))


@query(_brackets_sql(r"f AS (SELECT page_id, regexp_replace(coalesce(html, ''), '[^\x00-\x7F]', 'x', 'g') AS code FROM pages)", "page_id"))
def page_brackets(spark, sf):
    """The same of every page's source."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x00-\x7F]", "x").alias("code"), F.lit("html").alias("language"))
    return rounded(ast33.with_ast33(p).drop("code", "language"))


@query()
def script_tree_features(spark, sf):
    """The 33 syntax features of every script, from its tree."""
    return rounded(ast33.with_ast33(scripts(spark, sf).withColumn("language", F.lit("python"))).drop("code", "language"))


# ---- depth of braces, trees of pages ----

def _braces_sql(texts: str, id_: str) -> str:
    return f"""WITH {texts}, c AS (SELECT {id_}, unnest(string_split(code, '')) AS c, unnest(range(length(code))) AS pos FROM f WHERE code <> ''),
s AS (SELECT {id_}, pos, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY {id_} ORDER BY pos) AS s FROM c),
d AS (SELECT {id_}, s - least(0, min(s) OVER (PARTITION BY {id_} ORDER BY pos)) AS d FROM s),
m AS (SELECT {id_}, max(d) AS most, avg(d) AS mean FROM d GROUP BY {id_})
SELECT {id_}, coalesce(most, 0)::DOUBLE AS max_brace_depth, round(coalesce(mean, 0), 6) AS avg_brace_depth FROM f LEFT JOIN m USING ({id_})"""


@query(_braces_sql(FOLD, "doc_id"))
def document_brace_depth(spark, sf):
    return rounded(lexical44.with_lexical44(folded(spark, sf), "code", ("structure",)).select("doc_id", "max_brace_depth", "avg_brace_depth"))


@query(_braces_sql(_texts_sql(CLASS, HEAD, TAIL), "ID"))
def class_brace_depth(spark, sf):
    return rounded(lexical44.with_lexical44(classes(spark, sf), "code", ("structure",)).select("ID", "max_brace_depth", "avg_brace_depth"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) SELECT lower(t) AS type, count(*) AS n FROM t GROUP BY lower(t)")
def page_types(spark, sf):
    """How often each element occurs in the trees of the pages."""
    return tree(spark, sf).where(~F.col("type").isin("#text", "document")).groupBy("type").agg(F.count("*").alias("n"))


@query()
def page_edges(spark, sf):
    """The edges of all kinds of the pages' trees."""
    return rounded(graph.edges(materialised(graph.truncated(tree(spark, sf)), "page-trees")))


# ---- languages of the documents ----

_ALIAS = "CASE lower(trim(lang)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clean.LANGUAGES.items()) + " END"


@query(f"SELECT doc_id, coalesce({_ALIAS}, 'python') AS language FROM documents")
def document_languages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean.language_alias(F.col("lang"), "python").alias("language"))


@query(f"SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL AND {_ALIAS} IS NULL GROUP BY lang")
def unknown_document_languages(spark, sf):
    return profile.unknown_languages(samples(spark, sf))
