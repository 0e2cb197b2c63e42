"""57 signature features: pattern counts by the length or the lines of a text, clipped to [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clip, hits, is_blank, lines_of, std

K1, K2, K5, LINES, HAS = 1000, 2000, 5000, "lines", "has"

# Feature, pattern, flags, what its count is divided by.
COUNTED = (
    ("gpt_docstring_style", r'"""(?:Generate|Create|Return|Calculate|Process|Handle|Manage|Analyze)', "i", K1),
    ("gpt_markdown_in_comments", r"```\w+|^\s*#\s*\*\*|\*\*\w+\*\*", "", K1),
    ("gpt_explanatory_comments", r"#\s*(?:This function|This method|This class|Note that|Important:|First,|Next,|Finally,)", "i", K1),
    ("gpt_step_by_step", r"#\s*Step\s+\d+:", "i", K1),
    ("gpt_verbose_names", r"\b[a-z_]{15,}\b", "", K1),
    ("gpt_type_everything", r"->\s*\w+", "", LINES),
    ("gpt_perfect_grammar", r"#\s*[A-Z][^.!?]*[.!?]", "", K1),
    ("gpt_educational_tone", r"\b(we|let's|let us|you can|you should)\b", "i", K1),
    ("claude_numbered_steps", r"#\s*\d+\.|#\s*Step\s+\d+:", "", K1),
    ("claude_ultra_verbose_docs", r'"""[\s\S]{300,}"""', "", K5),
    ("claude_polite_comments", r"\b(please|kindly|carefully|ensure|make sure|note that)\b", "i", K1),
    ("claude_careful_error_handling", r"try:[\s\S]{50,}except\s+\w+Error", "", K2),
    ("claude_explicit_assumptions", r"#\s*(?:Assume|Assuming|Given that)", "i", K1),
    ("claude_formatted_output", r"print\(f[\"'][\w\s:{}]+[\"']\)", "", LINES),
    ("copilot_inline_comments", r"\s+#\s+\w+", "", LINES),
    ("copilot_todo_markers", r"#\s*TODO:", "i", K1),
    ("copilot_single_line_funcs", r"^def\s+\w+\([^)]*\):\s*return\s+", "m", K1),
    ("copilot_predictive_naming", r"\b(result|output|value|data|item|index)\b", "", K1),
    ("copilot_context_aware", r"\b(previous|next|current|last|first)\b", "", K1),
    ("deepseek_fill_style", r"<\|fim_.*?\|>", "", HAS),
    ("deepseek_heavy_typing", r":\s*(?:int|str|float|bool|list|dict|tuple)\b", "", LINES),
    ("deepseek_complete_annotations", r"def\s+\w+\([^)]*\)\s*->\s*\w+:", "", K1),
    ("deepseek_defensive_checks", r"if\s+(?:not\s+)?\w+\s+is\s+(?:None|not None)|assert\s+\w+", "", LINES),
    ("deepseek_optimal_imports", r"^from\s+\w+\s+import\s+\w+(?:,\s*\w+)*$", "m", K1),
    ("llama_long_descriptive_names", r"\b[a-z_]{20,}\b", "", K1),
    ("llama_explicit_logic", r"#\s*(?:Explicitly|Clearly|Obviously)", "", K1),
    ("llama_verbose_conditionals", r"if\s+[^:]{30,}:", "", LINES),
    ("llama_safety_first", r"\b(validate|sanitize|check|verify|ensure_safe)\b", "i", K1),
    ("llama_conventional_structure", r"if\s+__name__\s*==\s*[\"']__main__[\"']:", "", HAS),
    ("starcoder_typing_module", r"^from typing import", "m", HAS),
    ("starcoder_star_imports", r"from\s+\w+\s+import\s+\*", "", K1),
    ("starcoder_idiomatic", r"\[[^\]]+for\s+\w+\s+in\s+[^\]]+\]", "", K1),
    ("starcoder_pattern_matching", r"\bmatch\s+\w+:", "", HAS),
    ("starcoder_modern_syntax", r":=", "", K1),
    ("gemma_balanced_verbosity", r"#[^#\n]{10,50}$", "m", LINES),
    ("gemma_practical_comments", r"#\s*(?:Usage|Example|Note):", "i", K1),
    ("gemma_efficient_code", r"\b(cache|optimize|efficient|fast)\b", "i", K1),
    ("mistral_concise_style", r'"""[^"]{10,80}"""', "", K1),
    ("mistral_direct_approach", r"\breturn\s+\w+\([^)]*\)", "", K1),
    ("mistral_performance_focused", r"\b(faster|optimized|efficient|quick)\b", "i", K1),
    ("qwen_chinese_influence", r"\b[a-z]+(?:_[a-z]+){3,}\b", "", K1),
    ("qwen_thorough_docs", r'"""[\s\S]{150,300}"""', "", K2),
    ("qwen_edge_case_handling", r"#\s*(?:Edge case|Corner case|Special case)", "i", K1),
    ("qwen_academic_style", r"#\s*(?:Algorithm|Complexity|Reference|Citation)", "i", K1),
    ("qwen_comprehensive_tests", r"#\s*Test:", "i", K1),
    ("ai_perfect_formatting", r"\w+\s*[=+\-*/]\s*\w+", "", K1),
    ("ai_generic_names", r"\b(result|data|value|item|temp|obj|elem|node)\b", "", K1),
    ("ai_complete_error_handling", r"except\s+\w+Error(?:\s+as\s+\w+)?:", "", K1),
    ("ai_standardized_structure", r"^(?:    )+\w+", "m", LINES),
)
#: What every match of a pattern contains: texts without it, most of them, have no match, and aren't searched by the pattern.
NEEDED = {
    **{n: "#" for n, p, *_ in COUNTED if p.startswith(("#", r"\s+#"))}, **{n: '"""' for n, p, *_ in COUNTED if p.startswith('"""')},
    "gpt_type_everything": "->", "claude_careful_error_handling": "try:", "claude_formatted_output": "print(f", "copilot_single_line_funcs": "def", "deepseek_fill_style": "<|fim_", "deepseek_heavy_typing": ":",
    "deepseek_complete_annotations": "def", "deepseek_optimal_imports": "import", "llama_verbose_conditionals": "if", "llama_conventional_structure": "__name__", "starcoder_typing_module": "typing", "starcoder_star_imports": "import",
    "starcoder_idiomatic": "[", "starcoder_pattern_matching": "match", "starcoder_modern_syntax": ":=", "mistral_direct_approach": "return", "qwen_chinese_influence": "_", "ai_complete_error_handling": "except", "ai_standardized_structure": "    ",
}
SNAKE, CAMEL = r"\b[a-z]+_[a-z_]+\b", r"\b[a-z]+[A-Z][a-zA-Z]+\b"
CLASS, DEF, DEF_LINE = r"\bclass\s+\w+", r"\bdef\s+\w+", r"^def\s+\w+"
DEAD = r"^\s*#\s*\w+\s*[=\(]"
OTHERS = ("deepseek_clean_structure", "llama_clear_separation", "gemma_standard_patterns", "mistral_minimal_comments", "ai_consistent_style", "ai_over_engineering", "ai_no_dead_code", "ai_uniform_complexity")
FAMILIES = ("gpt", "claude", "copilot", "deepseek", "llama", "starcoder", "gemma", "mistral", "qwen", "ai")
NAMES = tuple(f for family in FAMILIES for f in (*(n for n, *_ in COUNTED), *OTHERS) if f.startswith(family + "_"))


def _hits(code: Column, pattern: str, flags: str, needed: str | None) -> Column:
    """hits(), 0 at once where needed isn't in the text."""
    n = hits(code, pattern, flags)
    return F.when(F.contains(code, F.lit(needed)), n).otherwise(0) if needed else n


def _gaps(code: Column) -> Column:
    """The distances between the starts of line-initial definitions: the text is cut at them, and each piece is as long as the gap."""
    pieces = F.split(code, r"(?dUm)(?=^def\s+\w+)")
    starts = F.filter(pieces, lambda p: p.rlike(r"(?dU)\Adef\s+\w+"))
    return F.slice(F.transform(starts, F.length), F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0)))


def feature(name: str, code: Column, lines: Column, size: Column, n: Column) -> Column:
    """One feature of a text that isn't null, from it, its lines, and one more than its length and than their number."""
    for other, pattern, flags, by in COUNTED:
        if other == name:
            c = _hits(code, pattern, flags, NEEDED.get(name))
            return (c > 0).cast("double") if by == HAS else c / n if by == LINES else c / (size / by)
    if name == "deepseek_clean_structure":
        return F.size(F.filter(lines, lambda x: ~F.substring(x, -1, 1).rlike(r"(?U)[\s\x1c-\x1f]"))) / n
    if name == "llama_clear_separation":
        return F.size(F.filter(lines, is_blank)) / n
    if name == "gemma_standard_patterns":
        return F.when(F.contains(code, F.lit("import")) & F.contains(code, F.lit("\n\n")), 0.7).otherwise(0.5)
    if name == "mistral_minimal_comments":
        return 1.0 - _hits(code, r"\s+#\s+\w+", "", "#") / n
    if name == "ai_consistent_style":
        snake, camel = _hits(code, SNAKE, "", "_"), hits(code, CAMEL)
        return F.greatest(snake, camel) / (snake + camel + 1)
    if name == "ai_over_engineering":
        return (_hits(code, CLASS, "", "class") + _hits(code, DEF, "", "def")) / n
    if name == "ai_no_dead_code":
        return 1.0 - F.least(_hits(code, DEAD, "m", "#") / n, F.lit(1.0))
    if name == "ai_uniform_complexity":
        gaps = _gaps(code)
        return F.when(_hits(code, DEF_LINE, "m", "def") < 2, F.lit(0.5)).otherwise(1.0 - F.least(std(gaps) / 1000, F.lit(1.0)))
    raise KeyError(name)


def with_signature57(df: DataFrame, code: str = "code", families=FAMILIES) -> DataFrame:
    """df with the features of the families asked for; a null or empty text has zeros. Families are structs first, so that no
    stage of generated code has more than a few columns."""
    text = F.coalesce(F.col(code), F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumn("_code", text).withColumn("_lines", lines_of(F.col("_code")))
    df = df.withColumns({"_size": (F.length("_code") + 1).cast("double"), "_n": (F.size("_lines") + 1).cast("double")})
    value = lambda name: F.when(F.col("_code") == "", F.lit(0.0)).otherwise(clip(feature(name, *map(F.col, ("_code", "_lines", "_size", "_n"))))).alias(name)
    df = df.select(*kept, *(F.struct(*(value(n) for n in NAMES if n.startswith(f + "_"))).alias(f"_{f}") for f in families))
    return df.select(*kept, *(f"_{f}.*" for f in families))


def family_scores(df: DataFrame) -> DataFrame:
    """df with the mean of each family's features."""
    for f in FAMILIES:
        names = [n for n in NAMES if n.startswith(f + "_")]
        df = df.withColumn(f"score_{'ai_generic' if f == 'ai' else f}", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names))
    return df
