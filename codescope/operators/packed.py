"""The trees of graph.nodes() a text at a time instead of a row a node: many texts at once, in numpy.

JVM expressions cut texts into tokens (nesting.tokens()). What nesting.nodes() finds by windows over rows is found here by running
sums and by sorts over the tokens of a batch, so nodes are neither shuffled nor sorted by Spark, and a text is cut once. Other
languages' texts go through their provider. Types, parents, depths, sizes and counts are those of graph.nodes(); texts of nodes
aren't here."""

from __future__ import annotations

from collections import namedtuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, nesting

#: Tokens that are worked on at once, more only where one text has more.
TOKENS_AT_ONCE = 1 << 18
#: Nodes of several trees after each other, in preorder: row (of each tree), count (its nodes), names; a node's type (a place in names),
#: depth, parent (a place among all nodes; -1: none), size, child_count, and start (None where leaves are in order of place).
Trees = namedtuple("Trees", "row count names type depth parent size child_count start")


def kind_of(tok: str, language: str, letters) -> str:
    """nesting.kind(); letters are the letters beyond ASCII."""
    first, two = tok[0], tok[:2]
    if two in ("//", "/*"):
        return "comment"
    if first == "#" and len(tok) > 1:
        return "comment" if language == "php" else "directive" if language in ("c", "cpp", "c_sharp") else tok
    if language == "php" and (two in ("?>", "<?") or (tok.endswith("<?php") and len(tok) > 5) or (tok.endswith("<?=") and len(tok) > 3)):
        return "markup"
    if len(tok) > 1 and (tok[-1] in "\"'`" or tok.startswith("<<<")):
        return "string"
    if first in "0123456789" or (first == "." and tok[1:2] in tuple("0123456789")):
        return "number"
    if tok in _KEYWORDS:
        return tok
    return "identifier" if tok != "$" and (first in "_$" or (first.isascii() and first.isalpha()) or first in letters) else tok


_KEYWORDS = frozenset(nesting.KEYWORDS)


def last(marked: np.ndarray, begins: np.ndarray, before: bool = False) -> np.ndarray:
    """For each place the last marked one up to it (before it), not beyond where its segment begins; -1: none."""
    at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1)) if len(marked) else np.zeros(0, np.int64)
    if before and len(at):
        at = np.concatenate([[-1], at[:-1]])
    return np.where(at >= begins, at, -1)


def begins(keys: np.ndarray) -> np.ndarray:
    """For each place of sorted keys where its key begins."""
    return np.maximum.accumulate(np.where(np.diff(keys, prepend=keys[:1] - 1) != 0, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)


def nested(cut, languages: list, letters: set) -> Trees:
    """The trees of texts from their tokens (a list array); texts without tokens have none."""
    size = np.asarray(cut.value_lengths().fill_null(0)).astype(np.int64)
    row = np.flatnonzero(size)
    size, flat = size[row], cut.flatten().dictionary_encode()
    ids: dict = {}
    of = lambda x: ids.setdefault(x, len(ids))
    some = lambda xs: np.array([of(x) for x in xs], np.int64)
    raws, code = flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64)
    bare = [x.lstrip(nesting.SPACE) for x in raws]
    groups = ("", "php", "c")
    kinds = np.zeros((3, len(raws)), np.int64)
    for k, x in enumerate(bare):
        kinds[:, k] = of(kind_of(x, "", letters))
        if x[0] in "#?" or "<?" in x:
            kinds[:, k] = [of(kind_of(x, y, letters)) for y in groups]
    tok = some(bare)[code]
    s = np.repeat(np.arange(len(row)), size)
    spoken = np.array([1 if languages[k] == "php" else 2 if languages[k] in ("c", "cpp", "c_sharp") else 0 for k in row], np.int64)
    kind = kinds[spoken[s], code]
    new_line = np.array(["\n" in x for x in raws], bool)[code] & np.array([languages[k] == "go" for k in row], bool)[s]
    first = np.cumsum(size) - size

    # levels
    opens, closing = np.isin(tok, some("([{")), np.isin(tok, some(")]}"))
    total = np.cumsum(opens.astype(np.int64) - closing)
    total -= np.concatenate([[0], total])[first][s]
    wide = 2 * len(tok) + 2
    least = np.minimum(0, np.minimum.accumulate(total - s * wide) + s * wide) if len(tok) else total
    level = total - least
    before = np.concatenate([[0], level[:-1]])
    before[first] = 0
    closes = closing & (before > 0)
    level = np.where(closes, before, level)

    # an opening bracket stands twice: as the group, and as a leaf of it
    i = np.repeat(np.arange(len(tok)), 1 + opens)
    leaf = np.ones(len(i), bool)
    leaf[(np.cumsum(1 + opens) - 2)[opens]] = False
    s, tok, kind, new_line, opens, closes, level = s[i], tok[i], kind[i], new_line[i], opens[i], closes[i], level[i] - ~leaf
    begin = np.flatnonzero(np.diff(s, prepend=-1))
    key = s * (level.max(initial=0) + 1) + level
    order = np.argsort(key, kind="stable")
    found = last((opens & leaf)[order], begins(key[order]))
    group = np.full(len(i), -1)
    group[order] = np.where(found >= 0, order[found], -1)
    group[level == 0] = -1
    opener = np.where(group >= 0, tok[group], -1)
    brace, semicolon = of("{"), of(";")
    change = np.where(opens & leaf & (tok == brace), 1, 0) - (closes & (opener == brace))
    braces = np.cumsum(change) - change
    braces -= braces[begin][s]

    # statements, of what isn't a bracket of its own group
    own = (opens & leaf) | closes
    rest = np.flatnonzero(~own)
    within = np.where(group >= 0, group, len(i) + s)[rest]
    order = np.argsort(within, kind="stable")
    at, segment = rest[order], begins(within[order])
    aside = np.isin(kind, some(("comment", "directive", "markup")))
    found = last(~aside[at], segment, before=True)
    b = np.where(found >= 0, at[found], -1)
    none, b_tok, b_kind, b_group = b < 0, np.where(b < 0, -1, tok[b]), np.where(b < 0, -1, kind[b]), opens[b] & (b >= 0)
    inside = np.isin(opener[at], [-1, brace])
    ended = none | ((b_tok == semicolon) & ~b_group) | ((b_tok == brace) & b_group & ~np.isin(tok[at], some(nesting.GO_ON)))
    line = new_line[at] & ~none & (b_group | np.isin(b_kind, some(("identifier", "number", "string", *nesting.GO_ENDS))))
    starting = inside & ~aside[at] & (ended | line)
    outside = aside[at] & (none | ((b_tok == semicolon) & ~b_group))
    found = last(starting, segment)
    stmt, starts = np.full(len(i), -1), np.zeros(len(i), bool)
    stmt[at] = np.where(inside & ~outside & (found >= 0), at[found], -1)
    starts[at] = starting

    # their types, and those of groups
    def holds(cond):
        yes = np.zeros(len(i), bool)
        yes[stmt[cond & (stmt >= 0)]] = True
        return yes

    in_braces, in_parens = holds(opens & (tok == brace)), holds(opens & (tok == of("(")))
    assigned, a_class = holds(np.isin(tok, some(("=", ":=", "+=", "-=", "*=", "/=")))), holds(np.isin(tok, some(nesting.CLASSES)))
    stmt_type = np.select([a_class & in_braces, in_braces & in_parens & ~assigned, assigned, in_parens], some(("class_declaration", "function_definition", "assignment", "call_statement")).tolist(), of("expression_statement"))
    for word, name in nesting.STATEMENTS.items():
        stmt_type[tok == of(word)] = of(name)
    named = ~none & ~b_group & (b_kind == of("identifier"))
    parens = np.where(named, of("argument_list"), np.where(~none & np.isin(b_kind, some(nesting.KEYWORDS)), of("condition"), of("parenthesized")))
    brackets = np.where(named | b_group, of("subscript"), of("array"))
    filled = (np.isin(b_tok, some(("=", "return", ",", ":", ":="))) & ~b_group) | (none & np.isin(opener[at], some("([")))
    group_type = np.zeros(len(i), np.int64)
    group_type[at] = np.where(tok[at] == of("("), parens, np.where(tok[at] == of("["), brackets, np.where(filled, of("initializer"), of("block"))))

    # nodes in preorder: the root, then of each element its statement, where it starts one, and itself
    is_first = np.zeros(len(i), bool)
    is_first[begin] = True
    count = 1 + starts + is_first
    me = np.cumsum(count) - 1
    n = int(count.sum())
    root = (me - count + 1)[begin]
    type_, depth, parent = np.full(n, of("program")), np.zeros(n, np.int64), np.full(n, -1)
    layers = level + braces
    out = np.isin(opener, [-1, brace]) & (stmt < 0)
    my_depth = np.where(own, layers + np.where(opens | (opener != brace), 2, 1), layers + np.where(out, 1, 2))
    depth[me], depth[me[starts] - 1] = my_depth, my_depth[starts] - 1
    type_[me] = np.where(own, tok, np.where(opens, group_type, np.where(np.isin(tok, some(")]}")), of("ERROR"), kind)))
    type_[me[starts] - 1] = stmt_type[starts]
    around = np.where(group >= 0, me[group - 1], root[s])  # a group stands before its bracket
    parent[me] = np.where(own | (stmt < 0), around, me[stmt] - 1)
    parent[me[starts] - 1] = around[starts]
    return Trees(row, np.add.reduceat(count, begin) if len(begin) else count, list(ids), type_, depth, parent, *sized(depth, parent), None)


def sized(depth: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes under each, itself included, and children."""
    size, order = np.ones(len(depth), np.int64), np.argsort(depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order], append=-1)) + 1
    for lo, hi in reversed(list(zip([0, *ends[:-1]], ends, strict=True)) if len(depth) else []):
        of = order[lo:hi]
        if depth[of[0]] > 0:
            np.add.at(size, parent[of], size[of])
    return size, np.bincount(parent[parent >= 0], minlength=len(depth))


def flattened(row: int, rows: list[tuple]) -> Trees:
    """What graph.flatten() gives of one text."""
    _, parent, _, depth, kind, _, start, children, size, _ = zip(*rows, strict=True)
    names, type_ = np.unique(np.array(kind, object).astype(str), return_inverse=True)
    return Trees(np.array([row]), np.array([len(rows)]), names.tolist(), *(np.array(x, np.int64) for x in (type_, depth, parent, size, children, start)))


def over(df: DataFrame, finish, schema: str, code: str = "code", id_: str = "ID", language: str | Column = "language") -> DataFrame:
    """finish(trees, ids, languages) -> record batches of schema, over the trees of all texts that graph.nodes() has nodes of."""
    lang = F.col(language) if isinstance(language, str) else language
    providers = dict(graph.PROVIDERS)
    own = lang.isin([x for x in nesting.LANGUAGES if x not in providers])
    text = F.col(code)
    columns = df.select(F.col(id_).cast("long").alias("_id"), lang.alias("_lang"), F.when(own, nesting.tokens(text, lang)).alias("_cut"), F.when(own, F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}&&[^\x00-\x7F]]"), F.lit(0)))).alias("_letters"), F.when(lang.isin(list(providers)), text).alias("_text"))

    def run(batches):
        for b in batches:
            ids, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, text in enumerate(b.column(4).to_pylist()):
                parsed = providers[langs[k]](text) if text else None
                if parsed is not None:
                    yield from finish(flattened(k, graph.flatten(*parsed)), ids, langs)
            done = np.cumsum(np.asarray(b.column(2).value_lengths().fill_null(0)))
            cuts = np.flatnonzero(np.diff(done // TOKENS_AT_ONCE, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if done[hi - 1] > (done[lo - 1] if lo else 0):
                    yield from finish(nested(part.column(2), langs[lo:hi], set(part.column(3).flatten().to_pylist())), ids[lo:hi], langs[lo:hi])

    return columns.mapInArrow(run, schema)


def type_sums(df: DataFrame, code: str = "code", id_: str = "ID", language: str | Column = "language") -> DataFrame:
    """(language, type, n, size, depth, children): nodes by type, and sums over them. Only sums of batches are shuffled."""

    def finish(t: Trees, ids, langs):
        import pyarrow as pa

        known = sorted({langs[k] for k in t.row})
        spoken = np.repeat(np.array([known.index(langs[k]) for k in t.row], np.int64), t.count)
        key = spoken * len(t.names) + t.type
        n = np.bincount(key, minlength=len(known) * len(t.names))
        at = np.flatnonzero(n)
        sums = []
        for x in (t.size, t.depth, t.child_count):
            total = np.zeros(len(n), np.int64)
            np.add.at(total, key, x)
            sums.append(total[at])
        yield pa.RecordBatch.from_arrays([pa.array([known[k // len(t.names)] for k in at], pa.string()), pa.array([t.names[k % len(t.names)] for k in at], pa.string()), *(pa.array(x, pa.int64()) for x in (n[at], *sums))], names=["language", "type", "n", "size", "depth", "children"])

    parts = over(df, finish, "language string, type string, n long, size long, depth long, children long", code, id_, language)
    return parts.groupBy("language", "type").agg(*(F.sum(c).alias(c) for c in ("n", "size", "depth", "children")))


def packed(df: DataFrame, code: str = "code", id_: str = "ID", language: str | Column = "language") -> DataFrame:
    """(sample_id, types, parents, starts): a row a text that has nodes, arrays in preorder; starts is null where leaves are in order."""

    def finish(t: Trees, ids, langs):
        import pyarrow as pa

        offsets = np.concatenate([[0], np.cumsum(t.count)])
        parents = np.where(t.parent < 0, -1, t.parent - np.repeat(offsets[:-1], t.count))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x)
        used, type_ = np.unique(t.type, return_inverse=True)
        types = pa.array([t.names[k] for k in used], pa.string()).take(pa.array(type_))
        starts = pa.nulls(len(t.row), pa.list_(pa.int32())) if t.start is None else lists(pa.array(t.start, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in t.row], pa.int64()), lists(types), lists(pa.array(parents, pa.int32())), starts], names=["sample_id", "types", "parents", "starts"])

    return over(df, finish, "sample_id long, types array<string>, parents array<int>, starts array<int>", code, id_, language)
