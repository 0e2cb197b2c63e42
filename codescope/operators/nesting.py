"""Trees of C, C++, C#, Java, JavaScript, Go and PHP from the nesting of brackets, in expressions and windows, without a parser.

A text is cut into tokens by one pattern of its language, so brackets in strings and comments don't count. A running sum of
brackets gives each token its level (a closing bracket where nothing is open changes nothing; which bracket closes which isn't
checked). At each level the last opening bracket before a token is that of its group. Groups of braces, and the whole text, consist
of statements: up to a semicolon, or a group of braces that nothing goes on from (in Go, also up to a line's end). Every token is a
leaf; groups and statements are the inner nodes. Parents, places and sizes follow from preorder and depth.

The types are named after what decides them: a statement's first word, a bracket and what stands before it, the kind of a token;
words and marks that the language fixes are their own type and aren't named, as in grammars with anonymous nodes. These aren't the
trees of a grammar: expressions have no structure but their brackets.

Texts are dealt to tasks once, by sample; all windows over a sample use that. sample ids must be unique. Null and blank texts, and
languages that aren't here, have no nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.io import dealt
from .preorder import subtree_sizes, with_parents

TEXT = 200
#: Bytes of code, about, whose tokens a task sorts and passes over; more only where one text has more.
CODE_A_TASK = 1 << 20
SPACE = " \t\n\x0b\f\r"

# The lexical forms of the languages. *+ stands where a long text mustn't need a deep stack.
LINE, BLOCK = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)"
DOUBLE, SINGLE = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
LONG_DOUBLE, LONG_SINGLE = r'"(?:[^"\\]|\\(?s:.))*+"', r"'(?:[^'\\]|\\(?s:.))*+'"
DIRECTIVE = r"#(?:[^\n\\]|\\(?s:.))*+"
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
MARKS = r">>>=|<<=|>>=|>>>|===|!==|\*\*=|<=>|\?\?=|&&=|\|\|=|\.\.\.|->|=>|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.|<<|>>|[-+*/%&|^!=<>.]="
TAG = r"<\?(?:php\b|=)"
LANGUAGES = {
    "c": {"comment": (LINE, BLOCK), "directive": (DIRECTIVE,), "string": (DOUBLE, SINGLE), "digits": r"[\w.']"},
    "cpp": {"comment": (LINE, BLOCK), "directive": (DIRECTIVE,), "string": (r'R"([^()\s\\]{0,16})\((?s:.*?)\)\1"', DOUBLE, SINGLE), "digits": r"[\w.']"},
    "c_sharp": {"comment": (LINE, BLOCK), "directive": (DIRECTIVE,), "string": (r'"""(?s:.*?)"""', r'[@$]{1,2}"(?:[^"]|"")*+"', DOUBLE, SINGLE)},
    "java": {"comment": (LINE, BLOCK), "string": (r'"""(?s:.*?)"""', DOUBLE, SINGLE)},
    "javascript": {"comment": (LINE, BLOCK), "string": (r"`(?:[^`\\]|\\(?s:.))*+`", DOUBLE, SINGLE)},
    "go": {"comment": (LINE, BLOCK), "string": (r"`[^`]*`", DOUBLE, SINGLE)},
    "php": {"comment": (LINE, BLOCK, r"#[^\n\[][^\n]*"), "markup": (r"\?>(?s:.*?)(?:<\?(?:php\b|=)|\z)", TAG), "string": (r"""<<<[ \t]*['"]?(\w+)['"]?\n(?s:.*?)\n[ \t]*\1\b""", LONG_DOUBLE, LONG_SINGLE)},
}
KEYWORDS = (
    "abstract as async await boolean break byte case catch chan char class const constexpr continue default defer delete do double echo else "
    "elseif enum export extends extern final finally float for foreach friend func function global go goto if implements import in "
    "include inline instanceof int interface internal let long map module namespace native new null nullptr operator override "
    "package private protected public range readonly ref require return sealed select short signed sizeof static struct switch "
    "synchronized template this throw throws trait transient true false try type typedef typename union unset unsigned use using var "
    "virtual void volatile while with yield"
).split()
#: A statement's type by its first word; then what else decides it, in order.
STATEMENTS = {
    "if": "if_statement", "for": "for_statement", "foreach": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "select": "switch_statement",
    "return": "return_statement", "try": "try_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement", "goto": "goto_statement", "case": "case_statement", "default": "case_statement",
    "import": "import_declaration", "include": "import_declaration", "require": "import_declaration", "using": "import_declaration", "use": "import_declaration", "package": "package_declaration", "namespace": "package_declaration", "typedef": "type_definition",
}
CLASSES = ("class", "struct", "interface", "enum", "trait", "union")
GO_ON = ("else", "elseif", "catch", "finally", "while", ";", ",", ".", "=", "->", "?.", "(", "[")
#: Words after which a Go line ends a statement, beside names, numbers, strings and closed groups.
GO_ENDS = ("++", "--", "return", "break", "continue", "fallthrough")


def pattern(language: str) -> str:
    """White space and a token. Groups that capture are only referred to inside."""
    s = LANGUAGES[language]
    number = rf"\.?\d(?:[eEpP][+-]|{s.get('digits', '[' + chr(92) + 'w.]')})*+"
    forms = "|".join((*s["comment"], *s.get("markup", ()), *s["string"], *s.get("directive", ()), number, NAME, MARKS, r"\S"))
    return (rf"\A(?s:.*?){TAG}|" if "markup" in s else "") + rf"\s*(?:{forms})"


def tokens(code: Column, language: Column) -> Column:
    """The tokens of a text, each with the white space before it; null for languages that aren't here."""
    out = F.lit(None).cast("array<string>")
    for name in LANGUAGES:
        out = F.when(language == name, F.regexp_extract_all(code, F.lit(pattern(name)), F.lit(0))).otherwise(out)
    return out


def kind(token: Column, language: Column) -> Column:
    """What a token (without white space) is: comment, directive, markup, string, number, identifier, or itself."""
    first, two = F.substring(token, 1, 1), F.substring(token, 1, 2)
    hash_ = F.when(language == "php", "comment").when(language.isin("c", "cpp", "c_sharp"), "directive").otherwise(token)
    quoted = (F.length(token) > 1) & (F.substring(token, -1, 1).isin('"', "'", "`") | token.startswith("<<<"))
    return (
        F.when(two.isin("//", "/*"), "comment").when((first == "#") & (F.length(token) > 1), hash_).when((language == "php") & (two.isin("?>", "<?") | token.rlike(rf"\A(?s:.+){TAG}\z")), "markup")
        .when(quoted, "string").when(first.rlike(r"\d") | token.rlike(r"\A\.\d"), "number").when(token.isin(KEYWORDS), token).when(first.rlike(r"[\p{L}_$]") & (token != "$"), "identifier").otherwise(token)
    )


def levels(rows: DataFrame) -> DataFrame:
    """rows (sample_id, pos, tok) with opens, closes (a group that is open) and level: how many groups are open around a token, its
    own brackets' group included."""
    by = Window.partitionBy("sample_id").orderBy("pos")
    opens, closing = F.col("tok").isin("(", "[", "{"), F.col("tok").isin(")", "]", "}")
    summed = rows.withColumn("_sum", F.sum(F.when(opens, 1).when(closing, -1).otherwise(0)).over(by)).withColumn("_least", F.least(F.lit(0), F.min("_sum").over(by)))
    before = F.lag(F.col("_sum") - F.col("_least"), 1, 0).over(by)
    out = summed.withColumn("_before", before).withColumn("opens", opens).withColumn("closes", closing & (F.col("_before") > 0))
    return out.withColumn("level", F.when(F.col("closes"), F.col("_before")).otherwise(F.col("_sum") - F.col("_least")).cast("int")).drop("_sum", "_least", "_before")


def grouped(rows: DataFrame) -> DataFrame:
    """levels() with opener, the bracket of the group that a token or, for a closing bracket, its group's; group, its pos (-1: none);
    and braces: how many groups of braces are open before a token. An opening bracket stands twice: as a leaf of its group (leaf),
    and as the group, a level further out."""
    x = F.struct(F.col("level").alias("level"), F.lit(True).alias("leaf"))
    both = rows.select("*", F.explode(F.when(F.col("opens"), F.array(x, F.struct((F.col("level") - 1).alias("level"), F.lit(False).alias("leaf")))).otherwise(F.array(x))).alias("_x"))
    flat = both.withColumn("level", F.col("_x.level")).withColumn("leaf", F.col("_x.leaf")).drop("_x")
    by = Window.partitionBy("sample_id", "level").orderBy("pos", "leaf")
    last = F.last(F.when(F.col("opens") & F.col("leaf"), F.struct("pos", "tok")), ignorenulls=True).over(by)
    inside = F.col("level") > 0
    held = flat.withColumn("_g", F.when(inside, last)).withColumn("group", F.coalesce("_g.pos", F.lit(-1))).withColumn("opener", F.coalesce("_g.tok", F.lit(""))).drop("_g")
    change = F.when(~F.col("leaf"), 0).when(F.col("opens") & (F.col("tok") == "{"), 1).when(F.col("closes") & (F.col("opener") == "{"), -1).otherwise(0)
    order = Window.partitionBy("sample_id").orderBy("pos", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("braces", F.coalesce(F.sum(change).over(order), F.lit(0)).cast("int"))


def statements(rows: DataFrame) -> DataFrame:
    """grouped() with before (of what isn't a bracket of its own group: the token, kind and whether a group, before it in its group),
    starts, and stmt: the pos of the first token of their statement, null outside and for brackets."""
    own = (F.col("opens") & F.col("leaf")) | F.col("closes")
    by = Window.partitionBy("sample_id", F.col("group"), F.col("own")).orderBy("pos")
    aside = F.col("kind").isin("comment", "directive", "markup")
    e = rows.withColumn("own", own).withColumn("before", F.last(F.when(~aside, F.struct("tok", "kind", F.col("opens").alias("is_group"))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    b = F.col("before")
    ended = b.isNull() | ((b["tok"] == ";") & ~b["is_group"]) | ((b["tok"] == "{") & b["is_group"] & ~F.col("tok").isin(*GO_ON))
    line = (F.col("language") == "go") & F.col("new_line") & (b["is_group"] | b["kind"].isin("identifier", "number", "string", *GO_ENDS))
    inside = F.col("opener").isin("", "{") & ~F.col("own")
    e = e.withColumn("starts", inside & ~aside & (ended | F.coalesce(line, F.lit(False))))
    outside = aside & (b.isNull() | ((b["tok"] == ";") & ~b["is_group"]))
    return e.withColumn("stmt", F.when(inside & ~outside, F.last(F.when(F.col("starts"), F.col("pos")), ignorenulls=True).over(by)))


def _typed(e: DataFrame) -> DataFrame:
    """statements() with stmt_type, and the type of what is a group."""
    by = Window.partitionBy("sample_id", "stmt")
    some = lambda cond: F.max(cond.cast("int")).over(by) == 1
    group, tok, b = F.col("opens"), F.col("tok"), F.col("before")
    first = F.min_by("tok", "pos").over(by)
    by_word = F.element_at(F.create_map(*(F.lit(x) for kv in STATEMENTS.items() for x in kv)), first)
    braces, parens, assigned, a_class = some(group & (tok == "{")), some(group & (tok == "(")), some(tok.isin("=", ":=", "+=", "-=", "*=", "/=")), some(tok.isin(*CLASSES))
    stmt = F.coalesce(by_word, F.when(a_class & braces, "class_declaration").when(braces & parens & ~assigned, "function_definition").when(assigned, "assignment").when(parens, "call_statement").otherwise("expression_statement"))
    named_before = ~F.coalesce(b["is_group"], F.lit(False)) & (b["kind"] == "identifier")
    parens_type = F.when(F.coalesce(named_before, F.lit(False)), "argument_list").when(F.coalesce(b["kind"].isin(*KEYWORDS), F.lit(False)), "condition").otherwise("parenthesized")
    brackets_type = F.when(F.coalesce(named_before | b["is_group"], F.lit(False)), "subscript").otherwise("array")
    braces_type = F.when(F.coalesce(b["tok"].isin("=", "return", ",", ":", ":=") & ~b["is_group"], F.lit(False)) | (b.isNull() & F.col("opener").isin("(", "[")), "initializer").otherwise("block")
    return e.withColumn("stmt_type", stmt).withColumn("group_type", F.when(tok == "(", parens_type).when(tok == "[", brackets_type).otherwise(braces_type))


def lexed(df: DataFrame, code: str = "code", id_: str = "ID", language: str | Column = "language") -> DataFrame:
    """(sample_id, language, pos, tok, new_line, start (byte), ahead): a row a token. ahead is the text from the token on, where an
    inner node may begin."""
    lang = F.col(language) if isinstance(language, str) else language
    texts = df.select(F.col(id_).cast("long").alias("sample_id"), F.col(code).alias("_code"), lang.alias("language")).where(F.col("language").isin(*LANGUAGES))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_code")), F.lit(0))).first()[0]
    t = dealt(texts, "sample_id", size, CODE_A_TASK).select("sample_id", "language", tokens(F.col("_code"), F.col("language")).alias("t"))
    before = lambda i: F.substring(F.coalesce(F.get("t", i - 1), F.lit(";")), -1, 1)
    may = lambda x, i: F.substring(x, -1, 1).isin("(", "[", "{") | before(i).isin(";", "{", "}", "/") | F.contains(x, F.lit("\n"))
    cut = F.transform("t", lambda x, i: F.struct(x.alias("raw"), F.when(may(x, i), F.substring(F.array_join(F.slice(F.col("t"), i + 1, TEXT), ""), 1, TEXT + F.length(x))).alias("ahead")))
    rows = t.select("sample_id", "language", F.posexplode(cut).alias("pos", "x")).select("sample_id", "language", "pos", "x.*")
    by = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tok = F.ltrim("raw", F.lit(SPACE))
    start = F.coalesce(F.sum(F.octet_length("raw")).over(by), F.lit(0)) + F.octet_length("raw") - F.octet_length(tok)
    return rows.select("sample_id", "language", "pos", tok.alias("tok"), F.contains("raw", F.lit("\n")).alias("new_line"), start.cast("int").alias("start"), F.substring("ahead", F.length("raw") - F.length(tok) + 1, F.lit(TEXT)).alias("ahead"))


def nodes(df: DataFrame, code: str = "code", id_: str = "ID", language: str | Column = "language", max_nodes: int | None = None) -> DataFrame:
    """The trees of texts as rows in preorder: sample_id, node_id, parent_id, child_pos, depth, type, is_named, start, child_count,
    size, text. Sizes and counts are those of the whole tree, also where max_nodes keeps only its first nodes."""
    rows = lexed(df, code, id_, language).withColumn("kind", kind(F.col("tok"), F.col("language")))
    e = _typed(statements(grouped(levels(rows))))
    # groups around, braces among them, and the root: each is a layer, and statements are one more in braces and the root
    layers = F.col("level") + F.col("braces")
    outside = F.col("opener").isin("", "{") & F.col("stmt").isNull()
    depth = layers + F.when(outside, 1).otherwise(2)
    # a bracket is a leaf of its group, which its own brace doesn't count in yet
    mark_depth = layers + F.when(F.col("opens") | (F.col("opener") != "{"), 2).otherwise(1)
    node = lambda place, d, type_, named, text: F.struct((F.col("pos") * 3 + place).alias("key"), d.cast("int").alias("depth"), type_.alias("type"), named.alias("is_named"), F.col("start"), text.alias("text"))
    yes, no, inner, short = F.lit(True), F.lit(False), F.coalesce("ahead", "tok"), F.substring("tok", 1, TEXT)
    named = F.col("kind").isin("comment", "directive", "markup", "string", "number", "identifier")
    leaf_type = F.when(F.col("tok").isin(")", "]", "}"), "ERROR").otherwise(F.col("kind"))
    me = F.when(F.col("own"), node(2, mark_depth, F.col("tok"), no, short)).when(F.col("opens"), node(1, depth, F.col("group_type"), yes, inner)).otherwise(node(2, depth, leaf_type, named, short))
    root = F.struct(F.lit(-1).alias("key"), F.lit(0).alias("depth"), F.lit("program").alias("type"), yes.alias("is_named"), F.lit(0).alias("start"), inner.alias("text"))
    some = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    made = e.select("sample_id", F.explode(F.concat(some((F.col("pos") == 0) & (F.col("leaf") | F.col("closes")), root), some(F.col("starts"), node(0, depth - 1, F.col("stmt_type"), yes, inner)), F.array(me))).alias("x")).select("sample_id", "x.*")
    by = Window.partitionBy("sample_id").orderBy("key")
    numbered = made.select("sample_id", (F.row_number().over(by) - 1).alias("node_id"), "depth", "type", "is_named", "start", "text", (F.col("start") + F.octet_length("text")).alias("end"))
    tree = subtree_sizes(with_parents(numbered), last="end")
    # text has at most TEXT characters, so a node of four times as many bytes reaches beyond it
    octets = F.col("last_end") - F.col("start")
    cut = F.when((F.col("child_count") == 0) | (octets >= 4 * TEXT), F.col("text")).otherwise(F.decode(F.substring(F.encode("text", "utf-8"), F.lit(1), octets), "utf-8"))
    out = tree.select("sample_id", *(F.col(c).cast("int").alias(c) for c in ("node_id", "parent_id", "child_pos", "depth")), "type", "is_named", F.col("start").cast("int").alias("start"), F.col("child_count").cast("int").alias("child_count"), "size", cut.alias("text"))
    return out.where(F.col("node_id") < max_nodes) if max_nodes else out


def renamed(code: Column, language: Column, kept: list[str]) -> Column:
    """A text with its identifiers of two and more characters, but those in kept, as var_0, var_1, ... in order of name. Strings,
    comments and white space stay, and so does the $ before a PHP name. What has no tokens stays."""
    bare = lambda x: F.ltrim(x, F.lit(SPACE))
    name = lambda x: F.when(language == "php", F.ltrim(bare(x), F.lit("$"))).otherwise(bare(x))
    is_name = lambda x: (F.length(name(x)) > 1) & (kind(bare(x), language) == "identifier") & ~name(x).isin(*kept)

    def of(cut: Column) -> Column:
        known = F.array_sort(F.array_distinct(F.transform(F.filter(cut, is_name), name)))

        def put(known: Column) -> Column:
            new = lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(name(x))), F.lit("var_"), (F.array_position(known, name(x)) - 1).cast("string"))
            return F.array_join(F.transform(cut, lambda x: F.when((F.array_position(known, name(x)) > 0) & is_name(x), new(x)).otherwise(x)), "")

        return let(known, put)

    rest = lambda cut: F.substring(code, F.length(F.array_join(cut, "")) + 1, F.length(code))  # noqa: E731  white space that no token has
    return let(tokens(code, language), lambda cut: F.when(F.size(cut) > 0, F.concat(of(cut), rest(cut))).otherwise(code))
