"""Quality rules by weak supervision, in DataFrame functions alone.

Every rule votes good (1), bad (-1) or abstains (0). The votes of all documents that pass the base rule are counted by pattern of votes, of which
there are 3 to the power of the number of rules at most; expectation-maximisation over these counts, begun from the documents without a bad vote as good, estimates, for good
and for bad documents, how often a rule that votes votes bad; abstentions say nothing. The posterior probability that a document is good takes the
place of a filter that all rules must pass.

Defined results: null, empty and blank texts have no words, fail the base rule and aren't kept; repeated rows count as
often as they occur; very long texts are measured whole; a posterior of exactly KEEP_AT is kept; an empty table gives no
rows; further columns, whatever their names, are kept by keep_good() and not looked at.
Windows of three words are compared by a 64-bit hash within a document.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, let, table, word_array, written

ROUNDS = 20
KEEP_AT = 0.5
#: A rule's share of bad votes on good documents is estimated under the bound MOST_FALSE: without it a rule that alone fires on a
#: kind of junk is explained away, as votes of rules that don't fire together can't tell classes apart.
MOST_FALSE = 0.01
#: Votes of (share of bad, weight in votes) that are added to those cast on good and on bad documents; they vanish beside many.
GOOD_PRIOR = (MOST_FALSE, 20.0)
BAD_PRIOR = (0.25, 4.0)
#: name: (bad, good) as SQL conditions over the measures of a document; neither: the rule abstains.
RULES = {
    "length": ("FALSE", "n_words >= 100"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "lines": ("n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 4 AND 10 * n_dup_lines <= n_lines"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    "capitals": ("2 * n_upper > word_chars", "10 * n_upper <= word_chars"),
    "marks": ("3 * n_marks > n_words", "n_marks > 0 AND 5 * n_marks <= 2 * n_words AND n_words <= 60 * n_marks"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
            return let(F.array_sort(F.transform(twice, lambda e: e["i"])), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.get(p, j + 1) - x)), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), covered))

    return let(words, windows)


def measures(text: Column) -> Column:
    """A struct of what the rules look at."""
    whole = text
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
                F.length(F.regexp_replace(text, r"[^.!?]+", "")).cast("long").alias("n_marks"),
            ),
        )

    return let(word_array(whole), of_words)


def _condition(m: Column, sql: str) -> Column:
    """A condition as RULES has them (products compared, joined by AND or OR) over the struct m of measures."""

    def product(t: str) -> Column:
        return reduce(operator.mul, (F.lit(int(x)) if x.isdigit() else m[x] for x in t.split(" * ")))

    def compared(t: str) -> Column:
        if t == "FALSE":
            return F.lit(False)
        a, sign, b = re.fullmatch(r"(.+) (<=|>=|<|>) (.+)", t).groups()
        return {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[sign](product(a), product(b))

    return reduce(operator.or_, (reduce(operator.and_, map(compared, part.split(" AND "))) for part in sql.split(" OR ")))


def votes(m: Column) -> Column:
    """The votes of all rules, in their order, from measures."""
    return F.array(*(F.when(_condition(m, bad), F.lit(-1)).when(_condition(m, good), F.lit(1)).otherwise(F.lit(0)) for bad, good in RULES.values()))


def posteriors(counts: DataFrame) -> DataFrame:
    """counts (votes, n) of at most 3 ** rules rows -> (votes, p_good): all rounds are one expression over one array."""
    rules = len(RULES)
    one = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("ps"))

    def mass(ps: Column, q: Column, keep) -> Column:
        """Sum of n times the posterior (or its rest) of the patterns for which keep holds."""
        return F.aggregate(F.zip_with(ps, q, lambda p, x: F.when(keep(p), p["n"] * x).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)

    def step(ps: Column):
        def rates(q: Column, bad_rate: float, more: float, bound: float = 1.0) -> Column:
            """For each rule: the share of bad votes, bound at most, among the votes it casts on the documents that q weighs and
            so many more, of which bad_rate are bad."""

            def of(j: Column) -> Column:
                share = (mass(ps, q, lambda p: F.get(p["votes"], j) == -1) + bad_rate * more) / (mass(ps, q, lambda p: F.get(p["votes"], j) != 0) + more)
                return F.least(share, F.lit(bound))

            return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), of)

        def new(q: Column) -> Column:
            rest = F.transform(q, lambda x: 1.0 - x)
            both = F.struct(rates(q, *GOOD_PRIOR, MOST_FALSE).alias("g"), rates(rest, *BAD_PRIOR).alias("b"), (mass(ps, q, lambda p: F.lit(True)) + 1.0).alias("ng"), (mass(ps, rest, lambda p: F.lit(True)) + 1.0).alias("nb"))

            def posterior(m: Column) -> Column:
                def of(p: Column) -> Column:
                    def term(v: Column, j: Column) -> Column:
                        g, b = F.get(m["g"], j), F.get(m["b"], j)
                        return F.when(v == -1, F.log(b) - F.log(g)).when(v == 1, F.log(1 - b) - F.log(1 - g)).otherwise(F.lit(0.0))

                    terms = F.transform(p["votes"], term)
                    return 1.0 / (1.0 + F.exp(F.aggregate(terms, F.log(m["nb"]) - F.log(m["ng"]), lambda a, x: a + x)))

                return F.transform(ps, of)

            return let(both, posterior)

        return new

    start = F.transform(F.col("ps"), lambda p: F.when(F.array_contains(p["votes"], -1), F.lit(0.1)).otherwise(F.lit(0.95)))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda q, _: step(F.col("ps"))(q))
    return one.select(F.explode(F.arrays_zip(F.col("ps"), fitted.alias("q")).cast("array<struct<p:struct<votes:array<int>,n:bigint>,q:double>>")).alias("x")).select(F.col("x.p.votes").alias("votes_"), F.col("x.q").alias("p_good_"))


def counted(measured_: DataFrame) -> DataFrame:
    """A table with measures_ -> (votes, n) of the documents that pass the base rule; 3 ** rules rows at most."""
    return measured_.where(~base_failed(F.col("measures_"))).groupBy(votes(F.col("measures_")).alias("votes")).agg(F.count("*").alias("n"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, measures_, votes_ and p_good_ of docs (doc_id, text). Texts are measured once, into a table in the shared folder."""
    seen = written(docs.select("doc_id", measures(F.col("text")).alias("measures_")), "quality-measures")
    return seen.withColumn("votes_", votes(F.col("measures_"))).join(F.broadcast(posteriors(counted(seen))), "votes_", "left")


def base_failed(m: Column) -> Column:
    return _condition(m, BASE_FAILED)


def verdict() -> Column:
    return ~base_failed(F.col("measures_")) & F.coalesce(F.col("p_good_") >= KEEP_AT, F.lit(False))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs. Texts are measured twice, for the counts and for the verdicts:
    that takes no copy of the corpus. The patterns of votes that are kept, 3 ** rules at most, go to the driver."""
    seen = written(docs.select(measures(F.col("text")).alias("measures_")), "quality-measures")
    good = [r["votes_"] for r in posteriors(counted(seen)).where(F.col("p_good_") >= KEEP_AT).select("votes_").collect()]
    drop_written(seen)
    kept = F.array(*(F.concat_ws(",", F.array(*(F.lit(str(v)) for v in p))) for p in good)) if good else F.array().cast("array<string>")
    one = lambda m: ~base_failed(m) & F.array_contains(kept, F.concat_ws(",", votes(m).cast("array<string>")))
    return docs.where(let(measures(F.col("text")), one))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("measures_")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(m[k].alias(k) for k in MEASURES[:5]), base_failed(m).alias("base_failed"), verdict().alias("kept"))


def _rounds_sql() -> str:
    """The rounds of expectation-maximisation, one after the other."""
    parts = ["q0 AS (SELECT pid, n, CASE WHEN list_contains(votes, -1) THEN 0.1 ELSE 0.95 END AS q FROM pats)"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"t{k} AS MATERIALIZED (SELECT sum(n * q) AS g, sum(n * (1 - q)) AS b FROM q{k - 1})")
        parts.append(f"a{k} AS MATERIALIZED (SELECT j, least((coalesce(sum(n * q) FILTER (v = -1), 0) + {GOOD_PRIOR[0] * GOOD_PRIOR[1]}) / (sum(n * q) + {GOOD_PRIOR[1]}), {MOST_FALSE}) AS g, (coalesce(sum(n * (1 - q)) FILTER (v = -1), 0) + {BAD_PRIOR[0] * BAD_PRIOR[1]}) / (sum(n * (1 - q)) + {BAD_PRIOR[1]}) AS b FROM q{k - 1} JOIN cast_votes USING (pid) WHERE v <> 0 GROUP BY j)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT j, v, CASE WHEN v = -1 THEN ln(b) - ln(g) WHEN v = 1 THEN ln(1 - b) - ln(1 - g) ELSE 0 END AS w FROM (SELECT DISTINCT j, v FROM cast_votes) LEFT JOIN a{k} USING (j))")
        parts.append(f"q{k} AS MATERIALIZED (SELECT pid, any_value(n) AS n, 1 / (1 + exp(sum(w) + any_value(ln(b + 1) - ln(g + 1)))) AS q FROM q{k - 1} JOIN cast_votes USING (pid) JOIN r{k} USING (j, v), t{k} GROUP BY pid)")
    return ",\n".join(parts)


ORACLE_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win) WHERE c > 1),
reps AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
 length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^.!?]+', '', 'g'))::BIGINT AS n_marks FROM split LEFT JOIN reps USING (r)),
voted AS (SELECT *, [{", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values())}] AS votes FROM m),
pats AS MATERIALIZED (SELECT row_number() OVER (ORDER BY votes) AS pid, votes, n FROM (SELECT votes, count(*)::DOUBLE AS n FROM voted WHERE NOT ({BASE_FAILED}) GROUP BY votes)),
cast_votes AS MATERIALIZED (SELECT pid, unnest(range(1, len(votes) + 1)) AS j, unnest(votes) AS v FROM pats),
{_rounds_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND coalesce(q >= {KEEP_AT}, FALSE) AS kept
FROM voted LEFT JOIN pats USING (votes) LEFT JOIN q{ROUNDS} USING (pid)
"""
