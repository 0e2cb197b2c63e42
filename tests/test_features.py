"""Features against plain-Python models on small texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescope.functions import ast33, lexical44, signature57, stylometric12
from codescope.functions.text import normalise, strip

PYTHON = '''import os
from typing import List


def total_of_values(values: List[int], start: int = 0) -> int:
    """Calculate the total of all values in the given list, starting from the start."""
    # Step 1: check the input
    if not values is None:
        result = start
    for value in values:
        result = result + value  # add
    try:
        return int(result)
    except ValueError as error:
        raise error


class Stack(object):
    def push(self, item):
        self.items.append(item)

    def fact(self, n):
        return 1 if n < 2 and n >= 0 else n * self.fact(n - 1)
# TODO: more
if __name__ == "__main__":
    print(f"done: {total_of_values([1, 2])}")
'''
C = "#include <bits/stdc++.h>\nusing namespace std;\nint add(int a, int b) {\n    /* sum\n of both */\n    if (a > 0) { return a + b; }\n    for (;;) { break; }\n    return add(a, b); // again\n}\n"
TEXTS = [PYTHON, C, "", "   \n\t", "x", "été naïve\n\nété = 1\n", "a\r\nb\t \r c  ", None, "}}{{}", "def f(:\n  '''open"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "ID long, code string").cache()


def rows(df):
    return {r["ID"]: r.asDict() for r in df.collect()}


def entropy(items):
    c = Counter(items)
    n = sum(c.values())
    return -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0


def test_normalise(texts):
    for i, got in rows(texts.select("ID", normalise(F.col("code")).alias("n"), strip(F.col("code")).alias("s"))).items():
        text = (TEXTS[i] or "").replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ")
        assert got["n"] == "\n".join(x.rstrip() for x in text.split("\n"))
        assert got["s"] == (None if TEXTS[i] is None else TEXTS[i].strip())


def test_lexical44(texts):
    got = rows(lexical44.with_lexical44(texts))
    assert len(got[0]) == 46
    for i, r in got.items():
        code = TEXTS[i] or ""
        lines, tokens = code.split("\n"), re.findall(lexical44.TOKEN, code)
        sizes = [len(x) for x in lines]
        depth, depths = 0, []
        for c in code:
            depth = max(depth + (c == "{") - (c == "}"), 0)
            depths.append(depth)
        names = [t for t in tokens if re.match("[A-Za-z_]", t)]
        stripped = Counter(x.strip() for x in lines if x.strip())
        declared = re.findall(r"(?i)" + lexical44.DECLARED, code)
        want = {
            "total_chars": len(code), "total_lines": len(lines), "std_line_length": np.std(sizes, ddof=1) if len(sizes) > 1 else 0, "median_line_length": np.median(sizes), "total_tokens": len(tokens),
            "identifier_count": len(names), "unique_token_ratio": len(set(tokens)) / max(len(tokens), 1), "max_brace_depth": max(depths, default=0), "avg_brace_depth": np.mean(depths) if depths else 0,
            "control_flow_count": len(re.findall("(?i)" + lexical44.CONTROL, code)), "recursive_like_count": sum(len(re.findall(rf"\b{n}\s*\(", code)) > 1 for n in declared),
            "multi_line_comment_count": sum(len(re.findall(p, code, re.S)) for p in (r"/\*.*?\*/", '""".*?"""', "'''.*?'''")), "comment_line_ratio": len(re.findall(lexical44.COMMENT_LINE, code, re.M)) / len(lines),
            "char_entropy": entropy(code), "token_entropy": entropy(tokens), "bigram_entropy": entropy([code[k : k + 2] for k in range(len(code) - 1)]), "operator_diversity": len(set(re.findall(lexical44.OPERATORS, code))),
            "duplicate_line_ratio": sum(v > 1 for v in stripped.values()) / len(lines), "trailing_ws_ratio": sum(x != x.rstrip() for x in lines) / len(lines), "blank_line_ratio": sum(not x.strip() for x in lines) / len(lines),
        }
        for k, v in want.items():
            assert r[k] == pytest.approx(float(v), abs=1e-9), (i, k)


def test_signature57(texts):
    got = rows(signature57.family_scores(signature57.with_signature57(texts)))
    assert len(signature57.NAMES) == 57
    for i, r in got.items():
        code = TEXTS[i]
        if not code:
            assert all(r[n] == 0 for n in signature57.NAMES)
            continue
        size, n = len(code) + 1, len(code.split("\n")) + 1
        for name, pattern, flags, by in signature57.COUNTED:
            c = len(re.findall(pattern, code, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)))
            want = float(c > 0) if by == "has" else c / n if by == "lines" else c / (size / by)
            assert r[name] == pytest.approx(min(max(want, 0), 1)), (i, name)
        starts = [m.start() for m in re.finditer(signature57.DEF_LINE, code, re.M)]
        assert r["ai_uniform_complexity"] == pytest.approx(1 - min(np.std(np.diff(starts)) / 1000, 1) if len(starts) > 1 else 0.5)
        gpt = [r[x] for x in signature57.NAMES if x.startswith("gpt_")]
        assert r["score_gpt"] == pytest.approx(np.mean(gpt))
        assert all(0 <= r[x] <= 1 for x in signature57.NAMES)


def test_stylometric12(texts):
    got = rows(stylometric12.with_stylometric12(texts))
    assert all(got[i][k] == 0 for i in (2, 3, 7) for k in stylometric12.NAMES)
    r = got[0]
    marks = sum(PYTHON.upper().count(m) for m in stylometric12.MARKERS)
    solid = [x for x in PYTHON.split("\n") if x.strip()]
    assert r["human_markers"] == pytest.approx(min(1, marks / (len(solid) * 0.1)))
    assert r["line_length_variation"] == pytest.approx(min(1, np.std([*map(len, solid)]) / np.mean([*map(len, solid)])))
    assert r["whitespace_entropy"] == pytest.approx(min(1, entropy(re.findall(r"\s+", PYTHON)) / 4))
    bare = re.sub(r"#.*$", "", re.sub(r"[\"'].*?[\"']", "", PYTHON), flags=re.M)
    names = [x for x in re.findall(stylometric12.IDENTIFIER, bare) if x not in stylometric12.PYTHON_KEYWORDS]
    assert r["identifier_length"] == pytest.approx(min(1, np.mean([*map(len, names)]) / 20))
    assert r["identifier_entropy"] == pytest.approx(min(1, entropy([*map(len, names)]) / 5))
    assert 0 < r["token_diversity"] < 1 and r["indentation_consistency"] == 1.0


def test_token4(texts):
    got = rows(stylometric12.with_token4(texts))
    for i, r in got.items():
        code = TEXTS[i] or ""
        lines = code.split("\n")
        assert r["token_comment_ratio"] == pytest.approx(sum(x.strip().startswith(("//", "#", "/*", "*")) for x in lines) / len(lines))
        indents = [len(x) - len(x.lstrip()) for x in lines if x.strip()]
        assert r["token_indent_variance"] == pytest.approx(min(np.var(indents) / 100, 1) if len(indents) > 1 else 0)


def test_ast33(spark):
    df = spark.createDataFrame([(0, PYTHON, "python"), (1, C, "c"), (2, "def f(:", "python"), (3, None, "java"), (4, "", None)], "ID long, code string, language string")
    got = rows(ast33.with_ast33(df))
    p, c = got[0], got[1]
    assert (p["num_functions"], p["num_classes"], p["try_count"], p["import_count"], p["max_function_params"], p["inheritance_depth"]) == (3, 1, 1, 2, 2, 1)
    assert p["avg_methods_per_class"] == 2 and p["exception_specificity"] == 1 and p["docstring_ratio"] == 0.25 and p["return_annotation_ratio"] == pytest.approx(1 / 3)
    assert (c["num_functions"], c["if_count"], c["loop_count"], c["max_depth"], c["max_function_params"]) == (1, 1, 1, 2, 2)
    assert c["docstring_ratio"] == 2 and c["node_entropy"] == 3.0
    assert all(got[i][k] == 0 for i in (2, 3, 4) for k in ast33.NAMES)
    same = rows(ast33.with_ast33(df, compat_python_only=True))
    assert same[0] == p and all(same[1][k] == 0 for k in ast33.NAMES)


def test_tree_features_against_the_tree(spark):
    """Sources of Python's own library, and texts with what these may lack."""
    import ast
    import inspect
    import textwrap

    from python_tree_model import python_features

    texts = [inspect.getsource(m) for m in (ast, textwrap, inspect)] + [
        "import a, b.c\nfrom a import d\nfrom . import e\n", "async def f(a: int, *, b: str) -> int:\n    \"\"\"Doc.\"\"\"\n    # no\n    return a\n", "x", "# only", " \n", "\u00c9t\u00e9_x = \u01c5a = \u00aax = fooBar = _1 = 1\nprint(\u00c9t\u00e9_x, \u01c5a, fooBar, _1)",
        "try:\n  try:\n    pass\n  except:\n    pass\nexcept (A, B) as e:\n  pass", "class A(B, C):\n  class D: pass\n  def f(self): return [x for x in y if x]\n  def g(self, z: int = 1):\n    def h(): pass\n    if z:\n      while z: z -= 1", "(" * 300, "\0",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, code string").withColumn("language", F.lit(" Python "))
    got = rows(ast33.with_ast33(df))
    for i, t in enumerate(texts):
        assert [got[i][k] for k in ast33.NAMES] == pytest.approx(python_features(t), abs=1e-9), t[:50]


@pytest.mark.parametrize(("code", "value"), [
    ("x = 1", 1.0),  # one operator, spaced
    ("x=1", 0.0),
    ("a == b", 1 / 3),  # one spaced; two = and one == without regard to space
    ("a - b * c/d", 2 / 3),
    ("'q' \"w\"", 0.5),  # two of each kind of quotes
    ("'q'", 1.0),
    ("it\\'s", 0.5),  # an escaped quote is none, so no check applies
    ("print", 0.5),
    ("\ndef f(x):\n\n\n\ndef g(x):", 1.0),  # two definitions
    ("\ndef f(x):\n\ndef g(x):\n x=1", 0.5),  # and an operator without space
    ("def f(x):\n\ndef g(x):", 0.5),  # the first isn't after a line break
    ("'a' + \"b\" + 'c'", 5 / 6),  # (1 + 4/6) / 2
    (" \n", 0.0),  # blank texts have zeros throughout
])
def test_formatting_consistency(spark, code, value):
    df = spark.createDataFrame([(1, code)], "ID long, code string")
    assert stylometric12.with_stylometric12(df, "code", ("formatting_consistency",)).first()["formatting_consistency"] == pytest.approx(value)


def test_character_entropy(spark):
    from codescope.functions.text import character_entropy

    texts = ["", "a", "aab", "é€😀é", "".join(chr(0x4E00 + k) for k in range(400)) * 2, "ab\n\t " * 50]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(character_entropy(F.col("t"))).collect()]
    for t, h in zip(texts, got, strict=True):
        n = Counter(t)
        assert h == pytest.approx(-sum(c / len(t) * math.log2(c / len(t)) for c in n.values()) if t else 0.0), t[:9]


def test_comments_of_long_lines(spark):
    import re
    import time

    from codescope.functions import lexical44

    texts = ["", "#", "a # b", "a #", "a #\n\n b // c # d\n#", "\n\n\n  # x\n\n", "x//y//\nz", "# # #  \n \n", "a\n\n\n\nb", " \n # \n//\n", "é # ü\n # x", "x" * 3 + "#" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, code string")
    got = {r["id"]: (r["comment_line_ratio"], r["inline_comment_ratio"]) for r in lexical44.with_lexical44(df, groups=("comment",)).collect()}
    for k, t in enumerate(texts):
        n = t.count("\n") + 1
        assert got[k] == (len(re.findall(lexical44.COMMENT_LINE, t, re.M)) / n, len(re.findall(lexical44.COMMENT_INLINE, t)) / n), t
    began = time.time()
    long = spark.createDataFrame([("word " * 80_000,), ("\n" * 200_000,)], "code string")
    assert [r["inline_comment_ratio"] for r in lexical44.with_lexical44(long, groups=("comment",)).collect()] == [0.0, 0.0]
    assert time.time() - began < 60


def test_signatures_whose_needed_text_is_there():
    """What a pattern needs is in every text that it matches."""
    texts = [PYTHON, '"""Create a."""', "## x # Step 1: 2. # Test: it", "x -> y", "try:" + "x" * 60 + "except ValueError as e:", 'print(f"{a}")', "def f(a): return g(b) ", "<|fim_a|>", "a: int", "def f() -> int:", "from a import b", "from a import *",
             "if " + "a" * 31 + ":", 'if __name__ == "__main__":', "from typing import X", "[x for y in z]", "match x:", "a := b", "a_b_c_d", "        x", "# Usage: # Edge case # Algorithm # Given that", "# a long enough comment\n"]
    for name, pattern, flags, _ in signature57.COUNTED:
        needed = signature57.NEEDED.get(name)
        for text in texts:
            if needed and needed not in text:
                assert not re.search(pattern, text, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)), (name, text)


def test_bigram_entropy_of_wide_texts(spark):
    texts = ["", "a", "ab", "abab", "é\U0001f600é\U0001f600x", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, code string")
    got = {r["id"]: r["bigram_entropy"] for r in lexical44.with_lexical44(df, groups=("entropy",)).collect()}
    for k, t in enumerate(texts):
        c = Counter(a + b for a, b in zip(t or "", (t or "")[1:]))
        n = sum(c.values())
        assert got[k] == pytest.approx(math.log2(n) - sum(x * math.log2(x) for x in c.values()) / n if n else 0.0)


def test_training_features_are_computed_once(spark, tmp_path):
    from codescope.plans import queries

    rows = [(i, f"some text {i}, of words " * (1 + i % 7), "en", "web") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    f, names = queries._trained(spark, str(tmp_path))
    assert set(names) <= set(f.columns) and not any("documents" in x for x in f.inputFiles())


def test_bracket_depths_of_long_texts(spark):
    """Depths never fall below 0; time is in proportion to a text's brackets, of which copying what was found made a square."""
    texts = ["", "a", ")", ")](", "((a)[b]{", "x(" * 3 + ")" * 5 + "{[" * 2 + "}", "(f[1]{" * 200_000 + ")" * 7, None]
    got = {r["ID"]: r for r in ast33.with_ast33(spark.createDataFrame([(k, t, "java") for k, t in enumerate(texts)], "ID long, code string, language string")).collect()}
    for k, t in enumerate(texts):
        depths, d = [], 0
        for c in t or "":
            if c in "([{":
                d += 1
                depths.append(d)
            elif c in ")]}":
                d = max(d - 1, 0)
        m = sum(depths) / len(depths) if depths else 0
        want = {"max_depth": max(depths, default=0), "nesting_depth": max(depths, default=0), "avg_depth": m, "depth_std": math.sqrt(sum((x - m) ** 2 for x in depths) / len(depths)) if depths else 0, "max_breadth": max(Counter(depths).values(), default=0), "tree_balance": m / max(depths) if depths else 0}
        assert {n: got[k][n] for n in want} == pytest.approx(want)


def test_markers_and_the_order_of_stylometric_steps(spark):
    """Markers in any case, also within each other's words; Python's tokenizer gets the text before arrays are cut from it."""
    texts = ["todo TODO fixme\nTEMPTODO x", "no such\n\nthing", "NOTE", "", None]
    df = stylometric12.with_stylometric12(spark.createDataFrame(list(enumerate(texts)), "ID long, code string"))
    got = {r["ID"]: r["human_markers"] for r in df.collect()}
    for k, t in enumerate(texts):
        upper, full = (t or "").upper(), [x for x in (t or "").split("\n") if x.strip()]
        assert got[k] == pytest.approx(min(1.0, sum(upper.count(m) for m in stylometric12.MARKERS) / (len(full) * 0.1)) if full else 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[plan.index("ArrowEvalPython") :]
