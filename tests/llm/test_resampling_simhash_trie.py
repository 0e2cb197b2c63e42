"""Importance resampling, SimHash and the prefix trie against brute force, through their queries, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codescope.llm import importance_resampling, prefix_trie, simhash
from codescope.llm.common import joined_by_key, written

WORDS = "the of and to in is that for it was on are as with his they at be this from Éa ünd 日本 x1 don't".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "LY", "ing"]) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def odd_docs():
    """Nulls, empty, blank, wordless and very long texts, repeated rows and ids, near copies."""
    rng = random.Random(11)
    base = prose(rng, 150)
    rows = [(i, prose(rng, rng.randint(1, 90))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "-- ?!"), (None, base), (None, None), (104, base), (104, base), (104, "another text of this id"), (105, base + " end"), (106, prose(rng, 40_000)), (107, "y" * 100_000), (108, "a b"), (109, "A  b\n"), (-3, base.upper()), (110, "one\x00two\x7fthree")]
    return rows


def stored(spark, folder, **tables):
    """A folder of tables for a query, each of several files and with columns that the operators use inside."""
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("row", "n", "fp", "place", "node", "w1", "pos", "last", "component")})
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- importance resampling ----


def resampled_plainly(docs, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    of_s, of_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        n, bs = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (of_s + 10_000) / ((s[b] + 1) * (of_t + 10_000)))) for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    pool = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    place = {id(r): k + 1 for k, r in enumerate(pool[: 25 * len(pool) // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=str)


def test_resampling(spark, tmp_path):
    rng = random.Random(3)
    target = [prose(rng, 40) for _ in range(6)] + [None, "", "日本 日本"]
    sf = stored(spark, tmp_path, documents=(odd_docs(), "doc_id long, text string"), benchmark=([(k, t) for k, t in enumerate(target)], "item_id long, text string"))
    got = importance_resampling.op11_importance_resampling(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == resampled_plainly(odd_docs(), target)


def test_resampling_without_rows(spark):
    docs, none = spark.createDataFrame(odd_docs(), "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance_resampling.resampled(none, docs).collect() == []
    assert rows_of(importance_resampling.resampled(docs, none)) == resampled_plainly(odd_docs(), [])


def test_orders_of_three(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    got = importance_resampling.positions(docs, 3, 1 << 20).drop("row").collect()
    of = lambda f: zlib.crc32(f.encode()) % (1 << 20)
    assert sorted(map(tuple, got), key=str) == sorted([(of("a"), of("a b"), of("a b c")), (of("b"), of("b c"), of("b c d")), (of("c"), of("c d"), None), (of("d"), None, None)], key=str)


# ---- SimHash ----


def fingerprint_plainly(text, k=3):
    from xxhash import xxh64_intdigest

    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_plainly(values, radius):
    """For each value, all that it reaches."""
    values, group = list(values), {}
    for v in values:
        if v not in group:
            reach, todo = {v}, [v]
            while todo:
                a = todo.pop()
                new = {b for b in values if b not in reach and (a ^ b).bit_count() <= radius}
                reach |= new
                todo += new
            group |= dict.fromkeys(reach, reach)
    return group


def test_simhash(spark, tmp_path):
    docs = odd_docs()
    sf = stored(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    got = simhash.op12_simhash(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [fingerprint_plainly(t) for _, t in docs]
    group = components_plainly(set(fps), 2)
    least = {f: min((i for (i, _), g in zip(docs, fps, strict=True) if g in group[f] and i is not None), default=None) for f in set(fps)}
    assert rows_of(got) == sorted(((i, f"{f:016x}", least[f]) for (i, _), f in zip(docs, fps, strict=True)), key=str)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_hashing(spark, radius):
    """Chains of fingerprints at all small distances, the sign bit among the flipped ones."""
    rng, fps = random.Random(radius), {0, 1 << 63, (1 << 64) - 1}
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(5):
            fps.add(f)
            f ^= sum(1 << b for b in {63, *rng.sample(range(64), 3)} if rng.random() < 0.5)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), radius).collect()}
    pairs = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius}
    assert found <= pairs
    if radius % 2:
        assert found == pairs
    reach = lambda links: {a: frozenset(c) for a, c in _reached({signed(f) for f in fps}, links).items()}
    assert reach(found) == reach(pairs)


def _reached(ids, links):
    near, out = defaultdict(set), {}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for a in ids:
        if a not in out:
            reach, todo = {a}, [a]
            while todo:
                new = near[todo.pop()] - reach
                reach |= new
                todo += new
            out |= dict.fromkeys(reach, reach)
    return out


def test_simhash_pieces(monkeypatch):
    text = prose(random.Random(2), 500)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert simhash.fingerprint(text.encode()) == whole == fingerprint_plainly(text)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_joined_by_key(spark, monkeypatch):
    """Hot keys by broadcast and the others by shuffle give what a plain join gives."""
    from codescope.llm import common

    rows = spark.createDataFrame([(0, i) for i in range(300)] + [(i, i) for i in range(40)], "k long, x long")
    mapping = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    for share in (1, 20, 1000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert rows_of(joined_by_key(rows, mapping, ["k"], "n").select("k", "x", "v")) == rows_of(rows.join(mapping, "k").select("k", "x", "v"))


# ---- prefix trie ----


def trie_plainly(rows):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h, first = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = own.get(first, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in ms if len(whole[c]) == len(p))
        out.append((ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), len(children[p]), sum(not children[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def some_turns():
    rng, rows = random.Random(9), []
    openings = [("user", "héllo"), ("user", ""), ("system", "be brief"), ("user", "x" * 5000)]
    for c in [*range(-12, 90), 10**12, 10**12 + 1]:
        rows += [(c, t, *(openings[rng.randrange(4)] if t < 3 else (rng.choice(["user", "bot"]), rng.choice(["yes", "no", "日本"])))) for t in range(rng.randint(1, 9))]
    rows += [(200, None, None, None), (200, 1, "", ""), (200, 1, "user", None), (200, 1, "user", None), (None, 0, "user", "lost"), (201, 5, "a", "bc"), (202, 5, "ab", "c")]
    rows += [(c, t, "user", str(t % 3)) for c in (300, 301, 302) for t in range(150)]
    rows += [(c, 0, "user", "same") for c in range(400, 460)]
    return rows


def test_trie(spark, tmp_path):
    rows = some_turns()
    random.Random(1).shuffle(rows)
    sf = stored(spark, tmp_path, conversations=(rows, TURNS))
    assert rows_of(prefix_trie.op13_prefix_trie(spark, sf).select(COLUMNS)) == trie_plainly(rows)


def test_trie_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_trie_in_small_batches(spark):
    """Conversations and nodes that cross batches."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [r for r in some_turns() if r[0] is None or r[0] < 30 or 400 <= r[0]]
        assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).select(COLUMNS)) == trie_plainly(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_paths_with_a_long_head_in_common(spark):
    rows = [(c, t, "user", f"{c} {t}" if t >= 60 else str(t)) for c in range(0, 100, 5) for t in range(70)]
    every = written(prefix_trie.prefixes(prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, TURNS)))), "test")
    assert every.count() == 20 * 71
    assert rows_of(prefix_trie.trie(every).select(COLUMNS)) == trie_plainly(rows)
