"""Syntax trees as two relations, nodes and edges.

A provider parses one text into rows; everything after it is relational. Python (stdlib ast) and HTML (html.parser) come with
the engine, and trees of seven more languages from the nesting of their brackets, without a provider; register() adds others, or
replaces them."""

from __future__ import annotations

import ast
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import dealt, materialised
from . import nesting, preorder
from .selection import first_rows

NODES = "sample_id long, node_id int, parent_id int, child_pos int, depth int, type string, is_named boolean, start int, child_count int, size int, text string"
MAX_NODES = 512
TEXT = 200


def python_tree(code: str):
    """(type, named, start, text, children) nested, or None where the text is no Python."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    raw, starts = code.encode("utf-8", "surrogatepass"), [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)

    def place(n):
        if not hasattr(n, "lineno"):
            return 0, ""
        start = starts[n.lineno - 1] + n.col_offset
        return start, raw[start : min(start + 4 * TEXT, starts[n.end_lineno - 1] + n.end_col_offset)].decode("utf-8", "replace")[:TEXT]

    def make(n):
        start, text = place(n)
        return [type(n).__name__, not isinstance(n, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)), start, text, list(ast.iter_child_nodes(n))]

    return tree, make


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["document", True, 0, "", []]
        self.open, self.lines = [self.root], []

    def feed_all(self, text: str):
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(text)
        self.close()
        return self.root

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        node = [tag, True, self._at(), (self.get_starttag_text() or "")[:TEXT], []]
        self.open[-1][4].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if data.strip():
            self.open[-1][4].append(["#text", False, self._at(), data.strip()[:TEXT], []])


def html_tree(text: str):
    """None where the parser gives up, as on a marked section that it doesn't know."""
    try:
        return _Html().feed_all(text), lambda n: n
    except (AssertionError, ValueError, RecursionError, MemoryError):
        return None


PROVIDERS = {"python": python_tree, "html": html_tree}


def register(language: str, provider) -> None:
    """provider(text) -> (root, make) or None; make(node) -> [type, named, start, text, children]."""
    PROVIDERS[language] = provider


def flatten(root, make, order: str = "dfs") -> list[tuple]:
    """(node_id, parent_id, child_pos, depth, type, named, start, child_count, size, text) in preorder, or level by level."""
    rows, stack = [], deque([(root, -1, 0, 0)])
    while stack:
        node, parent, place, depth = stack.pop() if order == "dfs" else stack.popleft()
        kind, named, start, text, children = make(node)
        me = len(rows)
        rows.append([me, parent, place, depth, kind, named, start, len(children), 1, text])
        below = [(c, me, k, depth + 1) for k, c in enumerate(children)]
        stack += below[::-1] if order == "dfs" else below
    for r in reversed(rows):
        if r[1] >= 0:
            rows[r[1]][8] += r[8]
    return [tuple(r) for r in rows]


def nodes(df: DataFrame, code: str = "code", id_: str = "ID", language: str | Column = "language", fallback: str | None = None, max_nodes: int | None = None, order: str = "dfs") -> DataFrame:
    """The nodes of all texts that their language's provider can parse, or that nest; fallback, the name of a provider, parses the
    rest, else they have no rows. order is dfs or bfs; max_nodes keeps the first nodes in that order."""
    lang = F.col(language) if isinstance(language, str) else language
    own = [x for x in nesting.LANGUAGES if x not in PROVIDERS]
    nested = nesting.nodes(df.where(lang.isin(own)), code, id_, lang)
    if order != "dfs":
        nested = preorder.breadth_first(nested)
    if max_nodes:
        nested = nested.where(F.col("node_id") < max_nodes)
    return _provided(df.where(~F.coalesce(lang.isin(own), F.lit(False))), code, id_, lang, fallback, max_nodes, order).unionByName(nested)


def _provided(df: DataFrame, code: str, id_: str, lang: Column, fallback: str | None, max_nodes: int | None, order: str) -> DataFrame:
    providers = dict(PROVIDERS)

    def run(batches):
        for b in batches:
            for sample, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                provider = providers.get(lang) or providers.get(fallback)
                parsed = provider(text) if provider and text else None
                if parsed is None:
                    continue
                rows = flatten(*parsed, order)[:max_nodes]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in NODES.split(", ")])

    return df.select(F.col(id_).cast("long").alias("_id"), F.col(code).alias("_code"), lang.alias("_lang")).mapInArrow(run, NODES)


def unparsed(df: DataFrame, tree: DataFrame, id_: str = "ID") -> DataFrame:
    return df.join(tree.select(F.col("sample_id").alias(id_)).distinct(), id_, "left_anti")


def with_children_only(tree: DataFrame) -> DataFrame:
    """Without trees whose root has no child."""
    return tree.join(tree.where("node_id = 0 AND child_count > 0").select("sample_id"), "sample_id", "left_semi")


def truncated(tree: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    return tree.where(F.col("node_id") < max_nodes)


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """tree, in preorder and maybe truncated, with subtree: nodes of the table under each, itself included. In preorder they follow
    their node, so truncation cuts them at the table's end."""
    n = tree.groupBy("sample_id").agg(F.count("*").alias("n"))
    return tree.join(n, "sample_id").withColumn("subtree", F.least("size", F.col("n") - F.col("node_id")).cast("int")).drop("n")


def structural_features(tree: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Six features in [0, 1] with static bounds; the last is the size relative to the parent's."""
    t = preorder.with_parent(tree, parent_size="size")
    least = lambda x, by: F.least(F.lit(1.0), x / by)
    return t.select(
        "sample_id", "node_id", least(F.col("depth"), 100.0).alias("f_depth"), least(F.col("child_pos"), 50.0).alias("f_child_pos"), least(F.col("child_count"), 50.0).alias("f_child_count"),
        F.col("is_named").cast("double").alias("f_named"), least(F.col("size"), float(max_nodes)).alias("f_size"), F.coalesce(F.col("size") / F.col("parent_size"), F.lit(1.0)).alias("f_parent_share"),
    )


def graph_normalised_features(tree: DataFrame) -> DataFrame:
    """Depth, position and children relative to the largest of the same tree, leaf and named flags."""
    w = Window.partitionBy("sample_id")
    rel = lambda c: F.col(c) / F.greatest(F.max(c).over(w), F.lit(1))
    return tree.select("sample_id", "node_id", rel("depth").alias("f_depth"), rel("child_pos").alias("f_child_pos"), rel("child_count").alias("f_child_count"), (F.col("child_count") == 0).cast("double").alias("f_leaf"), F.col("is_named").cast("double").alias("f_named"))


def _both(pairs: DataFrame, there: int, back: int) -> DataFrame:
    return pairs.select("sample_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(there).alias("edge_type")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(back).alias("edge_type")))).alias("e")).select("sample_id", "e.*")


def parent_edges(tree: DataFrame) -> DataFrame:
    return _both(tree.where("parent_id >= 0").select("sample_id", F.col("parent_id").alias("a"), F.col("node_id").alias("b")), 0, 1)


def sibling_edges(tree: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample_id", "parent_id").orderBy("child_pos")
    return _both(tree.where("parent_id >= 0").select("sample_id", F.lag("node_id").over(w).alias("a"), F.col("node_id").alias("b")).where("a IS NOT NULL"), 2, 2)


def next_leaf_edges(tree: DataFrame) -> DataFrame:
    """Leaves (nodes without a child in the table) in order of place."""
    inner = tree.select("sample_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = tree.join(inner, ["sample_id", "node_id"], "left_anti")
    w = Window.partitionBy("sample_id").orderBy("start", "node_id")
    return _both(leaves.select("sample_id", F.col("node_id").alias("a"), F.lead("node_id").over(w).alias("b")).where("b IS NOT NULL"), 3, 3)


def traversal_edges(tree: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("node_id")
    return tree.select("sample_id", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.lit(4).alias("edge_type")).where("dst IS NOT NULL")


def edges(tree: DataFrame) -> DataFrame:
    """All four kinds; a tree of one node has a loop, one without edges a chain."""
    made = parent_edges(tree).unionByName(sibling_edges(tree)).unionByName(next_leaf_edges(tree))
    bare = tree.join(made.select("sample_id").distinct(), "sample_id", "left_anti")
    alone = bare.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("node_id").alias("src"))
    loops = alone.where("n = 1").select("sample_id", "src", F.col("src").alias("dst"), F.lit(0).alias("edge_type"))
    chains = traversal_edges(bare).withColumn("edge_type", F.lit(0))
    return made.unionByName(loops).unionByName(chains)


def vocabulary(tree: DataFrame, size: int = 8000) -> DataFrame:
    """(type, type_id): the most frequent types numbered from 1, ties by name. At most size rows."""
    top = tree.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(size - 1)
    return top.withColumn("type_id", F.row_number().over(Window.orderBy(F.desc("n"), "type")))


def sorted_vocabulary(tree: DataFrame) -> DataFrame:
    """(type, type_id): all types in order of name, numbered from 1. A row a type."""
    return tree.select("type").distinct().withColumn("type_id", F.row_number().over(Window.orderBy("type")))


def encoded(tree: DataFrame, vocab: DataFrame) -> DataFrame:
    from .joins import lookup

    return lookup(tree, vocab, "type", "type_id", 0)


def smoothed_type(t: Column) -> Column:
    t = F.lower(t)
    has = lambda *subs: F.array_contains(F.array(*(F.contains(t, F.lit(s)) for s in subs)), True)
    return F.when(has("identifier", "name"), "IDENTIFIER").when(has("string"), "STRING_LITERAL").when(has("number", "integer", "float"), "NUMERIC_LITERAL").when(has("function", "method"), "FUNCTION_DEF").when(has("comment"), "COMMENT").otherwise(t)


def shape(tree: DataFrame) -> DataFrame:
    return tree.groupBy("sample_id").agg(F.max("depth").alias("depth"), F.count("*").alias("n_nodes"))


def node_texts(tree: DataFrame, most: int = 500_000) -> DataFrame:
    """(text, n): the most frequent distinct texts, those of a frequency in order of text. The least frequency that is in is found
    from a count of texts a frequency, and the last text of that frequency from counts by its beginning; texts only get compared."""
    counts = materialised(tree.groupBy("text").agg(F.count("*").alias("n")), "node-texts")
    by = counts.groupBy("n").agg(F.count("*").alias("c"))
    last = by.withColumn("up", F.sum("c").over(Window.orderBy(F.desc("n")))).where(F.col("up") >= most).orderBy(F.desc("n")).first()  # a row a frequency
    if not last:
        return counts.orderBy("text")
    edge = first_rows(counts.where(F.col("n") == last["n"]), F.col("text"), most - (last["up"] - last["c"]), 1)
    return counts.where(F.col("n") > last["n"]).unionByName(edge).orderBy("text")


def assembled(tree: DataFrame, edge_table: DataFrame) -> DataFrame:
    """A row a sample: arrays of type ids (tree is encoded) and of edges. tree is a table that is cheap to count, and sets how many
    samples are in a partition."""
    nodes = tree.count()
    tree, edge_table = (dealt(x, "sample_id", nodes, preorder.NODES_A_TASK) for x in (tree, edge_table))
    n = tree.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "type_id"))), lambda x: x["type_id"]).alias("type_ids"))
    e = edge_table.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("edge_type", "src", "dst"))).alias("edges"))
    return n.join(e, "sample_id", "left")
