"""Vectors of graphs by rounds of neighbour aggregation, for the classifiers of Spark ML.

A graph is a row (graph.assembled()): the type ids of its nodes and its edges; graphs are cut to max_nodes before, which bounds a
row. Assembling is the only shuffle: all rounds run where the row lies, in numpy, many graphs at once as one graph of separate
parts. The layers' weights are drawn from a seed and not trained: what is trained is the head over the vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

EDGE_TYPES = 5
#: Nodes that are worked on at once, more only where one graph has more.
NODES_AT_ONCE = 1 << 15
#: Neighbours of a node that are added in turn; those beyond are added as a segment.
ONE_BY_ONE = 8


def layers(dims: int, rounds: int, seed: int) -> list[dict]:
    """Weights of each round: own, by edge type, and two attention vectors."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(size=shape) / np.sqrt(dims)
    return [{"own": draw(dims, dims), "by": draw(EDGE_TYPES, dims, dims), "from": draw(dims), "to": draw(dims)} for _ in range(rounds)]


def embedded(types: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A vector a type id, drawn from the seed and the id alone."""
    known, at = np.unique(types, return_inverse=True)
    return np.array([np.random.default_rng((seed, int(t) + 1)).normal(size=dims) for t in known]).reshape(-1, dims)[at]


def neighbours(edges: np.ndarray) -> list[tuple]:
    """By edge type: src in order of dst, the dst that occur, most frequent first, where in src those of each begin, and how many they are."""
    out = []
    for t in range(EDGE_TYPES):
        e = edges[edges[:, 0] == t]
        if len(e):
            e = e[np.argsort(e[:, 2], kind="stable")]
            begin = np.flatnonzero(np.diff(e[:, 2], prepend=-1))
            n = np.diff(np.append(begin, len(e)))
            order = np.argsort(-n, kind="stable")
            out.append((t, e[:, 1], e[begin[order], 2], begin[order], n[order]))
    return out


def summed(h: np.ndarray, src: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of h over the n of src from each of begin on (n falls): one of each at a time, as nearly all have one or two, and long ones
    by segments."""
    total = h.take(src[begin], axis=0)
    for k in range(1, min(int(n[0]), ONE_BY_ONE)):
        m = np.searchsorted(-n, -k)
        total[:m] += h.take(src[begin[:m] + k], axis=0)
    if long := np.searchsorted(-n, -ONE_BY_ONE):
        size = n[:long] - ONE_BY_ONE
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(begin[:long] + ONE_BY_ONE - first, size)
        total[:long] += np.add.reduceat(h.take(src[at], axis=0), first)
    return total


def passed(h: np.ndarray, edges: np.ndarray, w: dict, kind: str, near: list[tuple] | None = None) -> np.ndarray:
    """One round: relu of a node's own part and of what comes in over its edges (edge_type, src, dst): by edge type the mean of the
    neighbours (gcn; near is neighbours(), the same in all rounds), or all weighted by attention (gat)."""
    out = h @ w["own"]
    if kind == "gcn":
        for t, src, dst, begin, n in neighbours(edges) if near is None else near:
            out[dst] += summed(h, src, begin, n) / n[:, None] @ w["by"][t]
    elif len(edges):
        kind_, src, dst = edges.T
        moved = np.einsum("ed,edk->ek", h[src], w["by"][kind_])
        raw = moved @ w["from"] + (h @ w["own"])[dst] @ w["to"]
        raw = np.where(raw > 0, raw, 0.2 * raw)
        top = np.full(len(h), -np.inf)
        np.maximum.at(top, dst, raw)
        e = np.exp(raw - top[dst])
        total = np.zeros(len(h))
        np.add.at(total, dst, e)
        mixed = np.zeros_like(h)
        np.add.at(mixed, dst, moved * (e / total[dst])[:, None])
        out = out + mixed
    return np.maximum(out, 0)


def pooled(h: np.ndarray, graph: np.ndarray, n: int, query: np.ndarray) -> np.ndarray:
    """A row a graph: the mean of its nodes, beside their mean weighted by attention to query."""
    counts = np.maximum(np.bincount(graph, minlength=n), 1)[:, None]
    mean = np.zeros((n, h.shape[1]))
    np.add.at(mean, graph, h)
    raw, top, total, mixed = h @ query, np.full(n, -np.inf), np.zeros(n), np.zeros((n, h.shape[1]))
    np.maximum.at(top, graph, raw)
    e = np.exp(raw - top[graph])
    np.add.at(total, graph, e)
    np.add.at(mixed, graph, h * (e / total[graph])[:, None])
    return np.hstack([mean / counts, mixed])


def vectors_of(types: list[np.ndarray], edges: list[np.ndarray], dims: int, rounds: int, kind: str, jump: bool, seed: int) -> np.ndarray:
    """(graphs, 2 * dims). jump: a node's state is the largest of each coordinate over all rounds, not the last."""
    offsets = np.cumsum([0, *map(len, types)])
    every = np.concatenate([np.asarray(e, np.int64).reshape(-1, 3) + [0, o, o] for e, o in zip(edges, offsets, strict=False)])
    return vectors_at_once(np.concatenate(types).astype(np.int64), np.diff(offsets), every, dims, rounds, kind, jump, seed)


def vectors_at_once(types: np.ndarray, sizes: np.ndarray, edges: np.ndarray, dims: int, rounds: int, kind: str, jump: bool, seed: int) -> np.ndarray:
    """vectors_of() graphs after each other, of so many nodes each, their edges by places among all nodes."""
    h, near, states = embedded(types, dims, seed), neighbours(edges) if kind == "gcn" else None, []
    for w in layers(dims, rounds, seed):
        h = passed(h, edges, w, kind, near)
        states.append(h)
    if jump and states:
        h = np.max(states, axis=0)
    return pooled(h, np.repeat(np.arange(len(sizes)), sizes), len(sizes), np.random.default_rng((seed, 0)).normal(size=dims))


def graph_vectors(graphs: DataFrame, dims: int = 16, rounds: int = 3, kind: str = "gcn", jump: bool = True, seed: int = 7) -> DataFrame:
    """graphs (sample_id, type_ids, edges), as from graph.assembled() -> sample_id, vector (2 * dims). kind is gcn or gat. A graph
    without nodes has zeros; null edges are none."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            ids, types = b.column(0).to_pylist(), [np.array(t or [], np.int64) for t in b.column(1).to_pylist()]
            flat, size = b.column(2).flatten(), pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            every = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("edge_type", "src", "dst")], axis=1)  # 12 bytes an edge
            edges = np.split(every, np.cumsum(size)[:-1])
            lo = 0
            while lo < len(ids):
                hi, n = lo + 1, len(types[lo])
                while hi < len(ids) and n + len(types[hi]) <= NODES_AT_ONCE:
                    n += len(types[hi])
                    hi += 1
                found = vectors_of(types[lo:hi], edges[lo:hi], dims, rounds, kind, jump, seed) if n else np.zeros((hi - lo, 2 * dims))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["sample_id", "vector"])
                lo = hi

    return graphs.select("sample_id", "type_ids", "edges").mapInArrow(run, "sample_id long, vector array<double>")


def tree_edges(parent: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """graph.edges() of trees after each other, by places among all nodes. start is in order of node in each tree where leaves are."""
    tree, node = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(parent))
    below = node[parent >= 0]
    up = parent[below]
    order = np.argsort(up, kind="stable")
    alike = np.flatnonzero(np.diff(up[order]) == 0)
    a, b = below[order][alike], below[order][alike + 1]
    leaves = np.setdiff1d(node, up)
    leaves = leaves[np.lexsort((leaves, start[leaves], tree[leaves]))]
    beside = np.flatnonzero(np.diff(tree[leaves]) == 0)
    c, d = leaves[beside], leaves[beside + 1]
    alone = (np.cumsum(sizes) - sizes)[sizes == 1]
    return np.concatenate([np.stack([np.full(len(x), t), x, y], axis=1) for t, x, y in ((0, up, below), (0, alone, alone), (1, below, up), (2, a, b), (2, b, a), (3, c, d), (3, d, c))])


def tree_vectors(trees: DataFrame, vocab: DataFrame, dims: int = 16, rounds: int = 3, kind: str = "gcn", jump: bool = True, seed: int = 7) -> DataFrame:
    """graph_vectors() of whole trees as from packed.packed(), with vocab (type, type_id): edges are made where the tree lies, so nothing
    is shuffled. Types that vocab lacks are 0."""
    known = {r["type"]: r["type_id"] for r in vocab.collect()}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths()).astype(np.int64)
            done = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff(done // NODES_AT_ONCE, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                part, n = b.slice(lo, hi - lo), sizes[lo:hi]
                types = part.column(1).flatten().dictionary_encode()
                type_ids = np.array([known.get(t, 0) for t in types.dictionary.to_pylist()], np.int64)[np.asarray(types.indices)]
                parent, first = np.asarray(part.column(2).flatten()).astype(np.int64), np.repeat(np.cumsum(n) - n, n)
                start = np.arange(len(parent))
                ordered = np.repeat(np.asarray(part.column(3).is_null()), n)
                start[~ordered] = np.asarray(part.column(3).flatten())
                found = vectors_at_once(type_ids, n, tree_edges(np.where(parent < 0, -1, parent + first), n, start), dims, rounds, kind, jump, seed)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * dims, pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["sample_id", "vector"])

    return trees.select("sample_id", "types", "parents", "starts").mapInArrow(run, "sample_id long, vector array<double>")
