"""The training-data operators against brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codescope.llm import common, decontamination, language_id, line_dedup, mixing, ngram_join, personal_data, quality_classifier, quality_rules, token_output, warc_bundles
from codescope.llm.components import components
from codescope.llm.shingles import shingles

WORDS = "the of and to in is that for it was on are as with his they at be this from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "ly", "ing"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(60, 160)), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(20)]
    rows += [(20, None, "en", "s0"), (21, "", None, "s1"), (22, " \n\t ", "fr", None), (None, base, "en", "s2"), (23, base, "en", "s2"), (24, base, None, None), (24, base, None, None), (25, "é" * 3, "en", "s3"), (26, prose(rng, 30_000), "en", "s0"), (27, "y" * 200_000, "en", "s1"), (28, base + " more", "en", "s3")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns whose names the operators use inside."""
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit(1) for c in ("size", "n", "h", "votes_", "set_id", "key", "shard", "times")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


# ---- token output ----


def test_tokens_round_trip(spark, odd, empty):
    got = {(r["start"]): r for r in token_output.tokenise(spark, odd, 1 << 18).collect()}
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(token_output.tokenizer_path()), 0
    for doc_id, text in sorted(((r[0], r[1]) for r in odd_rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[at]
        assert (r["doc_id"], r["n_tokens"], r["ids_crc32"]) == (doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.tokenise(spark, empty).count() == 0


def test_encoder_equals_library():
    e = token_output.Encoder(token_output.tokenizer_path(), most=50)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "The", "É", "é", "ß", "Ø", "'s", "don't", "'ll", "$1,", "\x1c", "\x85", "\t", "\r", "µ", ".", ",", "...", "!?", " ", "\n", " ", "3.5", "İ", "Σ", "ΑΣ", "́", "😀", "<|endoftext|>", "<|", "-", "_", "漢"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for lo in range(0, 400, 50):
        ids, sizes = e.encode(pa.array(texts[lo : lo + 50]))
        for t, got in zip(texts[lo : lo + 50], np.split(ids, np.cumsum(sizes))[:-1], strict=True):
            assert got.tolist() == e.t.encode(t, add_special_tokens=False).ids, t


def test_wavelet_rank_select(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, 5000).astype(np.uint16) * 1000
    with open(tmp_path / "x.wave", "wb") as f:
        w = token_output.ShardWriter(f)
        for lo in range(0, 5000, 700):
            part = ids[lo : lo + 700]
            w.add([lo], np.array([len(part)]), part)
        w.close()
    s = token_output.Shard(str(tmp_path / "x.wave"))
    assert [s.access(i) for i in (0, 1, 511, 512, 4999)] == ids[[0, 1, 511, 512, 4999]].tolist()
    for token in (0, 7000, 39000, 1):
        assert s.count(token) == int((ids == token).sum()) and s.count(token, 100, 900) == int((ids[100:900] == token).sum())
        assert list(s.occurrences(token)) == np.flatnonzero(ids == token).tolist()
    assert np.concatenate([x for _, x in s.documents()]).tolist() == ids.tolist()


# ---- mixing ----


def seats_by_quotients(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


@pytest.mark.parametrize("weights,seats", [([53.0, 24, 23], 7), ([1.0] * 5, 3), ([1000.0] + [1.0] * 40, 60), ([0.0, 5, 5], 4), ([3.3], 9), ([2.0, 1], 0)])
def test_apportionment(spark, weights, seats):
    df = spark.range(1).select(F.array(*(F.struct(F.lit(w).alias("w")) for w in weights)).alias("ps"), F.lit(seats).cast("long").alias("s"))
    assert df.select(mixing.apportioned(F.col("ps"), F.col("s")).alias("q")).first()["q"] == seats_by_quotients(weights, seats)


def test_blocks_of_many_sources(spark):
    rng = random.Random(31)
    for weights in ([rng.random() * 10 ** rng.randint(0, 5) for _ in range(200)], [64.0] * 9, [1.0] * 40, [0.0, 900.0], [1e6, 1.0, 1.0], [0.0]):
        parties = spark.createDataFrame([(f"s{i}", 1, i, w) for i, w in enumerate(weights)], "source string, size long, i long, w double")
        got = {r["source"]: r["quota"] for r in mixing.blocks_of(parties).collect()}
        assert [got[f"s{i}"] for i in range(len(weights))] == seats_by_quotients(weights, int(sum(weights) / mixing.BLOCK + 0.5))


def test_running(spark):
    rng = random.Random(32)
    rows = [(i, rng.randrange(50), float(rng.randrange(9))) for i in range(500)]
    df = common.running(spark.createDataFrame(rows, "i long, k long, x double").repartition(5), "test-running", ["k", "i"], before="x")
    at, total = 0, 0.0
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["i"])):
        assert (r["place"], r["before"]) == (at, total)
        at, total = at + 1, total + r["x"]


def test_mix_in_whole_documents(spark):
    """The documents of a mix hold about the words that its targets ask for, none more than twice."""
    rng = random.Random(33)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(20, 120)), None if i % 7 == 0 else f"s{i % 5}") for i in range(1500)], "doc_id long, text string, source string")
    want = {r["source"]: r["target"] for r in mixing.taken(mixing.sizes(docs).select("doc_id", "source", "size")).select("source", "target").distinct().collect()}
    out = mixing.sizes(mixing.mixed(docs)).collect()
    took = Counter()
    for r in out:
        took[r["source"]] += r["size"]
    assert all(abs(took[s] - want[s]) < 0.12 * want[s] for s in want) and max(Counter(r["doc_id"] for r in out).values()) == 2


def test_mixing(spark, odd, empty):
    docs = mixing.sizes(odd.drop("size")).select("doc_id", "source", "size")
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(odd_rows())
    sources = sorted({r[3] for r in odd_rows() if r[3]}) + [None]
    size = Counter()
    for _, text, _, source in odd_rows():
        size[source] += len((text or "").split())
    weight, target, full = dict(zip(sources, (3, 1, 2) * 3, strict=False)), {}, set()
    while True:
        free = sum(w for s, w in weight.items() if s not in full)
        rate = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / free if free else 0
        over = {s for s in sources if s not in full and rate * weight[s] >= 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else rate * weight[s] for s in sources}
    took = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - target[s]) <= 2 * mixing.BLOCK for s in sources)
    assert collect(mixing.taken(docs.repartition(7))) == collect(mixing.taken(docs))
    assert mixing.taken(mixing.sizes(empty).select("doc_id", "source", "size")).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mixed_tells_rows_apart(spark, monkeypatch):
    """Rows that share an id, or have none, are in the mix as often as their own words ask for."""
    rng = random.Random(2)
    rows = [(None, prose(rng, 300), "a"), (None, prose(rng, 200), "a"), (None, None, "a"), (7, prose(rng, 200), "b"), (7, prose(rng, 90), "b"), (7, prose(rng, 90), "b"), (8, "", "b")]
    rows += [(100 + i, prose(rng, rng.randint(100, 200)), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine")).withColumn("k", F.lit(1))
    all_taken = [(r["doc_id"], r["size"], r["taken"]) for r in mixing.taken(mixing.sizes(docs).select("doc_id", "source", "size")).collect()]
    for most in (1_000_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        times = Counter((r["doc_id"], r["text"], r["size"]) for r in out.collect())
        for i, text, _ in rows:
            n, size = times[i, text, "mine"], len((text or "").split())
            fits = [t for j, s, t in all_taken if (j, s) == (i, size)]
            assert any(n in (t // size, -(-t // size)) for t in fits) if size else n == 0
        assert sum(times.values()) == out.count()


# ---- WARC ----


def test_warc(spark, monkeypatch):
    long_, short = "<p>" + "a" * 200, "tiny"
    rows = [(5, "http://a", long_), (3, None, long_), (9, "http://b\r\nX: 1", long_), (1, "u", short), (2, "u", short), (4, "u", None), (None, "u", long_), (7, "u", "é" * 60), (8, "u", "é" * 60), (3, None, long_), (11, "v", "z" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit(2)})
    manifest = warc_bundles.write_bundles(pages, f"{spark.conf.get('spark.checkpoint.dir')}/warc-test")
    got = warc_bundles.read_bundles(manifest).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted([(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "response", None), (4, "response", None), (None, "response", None), (7, "response", None), (8, "revisit", 7), (3, "response", None), (11, "response", None)], key=str)
    text = {r[0]: r[2] or "" for r in rows}
    assert all(r["payload_digest"] == hashlib.sha256(text[r["page_id"]].encode()).hexdigest() and r["payload_bytes"] == len(text[r["page_id"]].encode()) for r in got)
    paths = [r["path"] for r in manifest.collect()]
    found = [raw for p in paths for raw in warc_bundles.Bundle(p).get(7)]
    assert len(found) == 1 and warc_bundles.parsed(found[0])[2].decode() == "é" * 60
    where = warc_bundles.located(manifest).collect()
    assert sorted((r["page_id"] for r in where), key=str) == sorted((r[0] for r in rows), key=str)
    at = next(r for r in where if r["page_id"] == 5)
    assert warc_bundles.parsed(warc_bundles.Bundle(at["path"]).frame(at["frame"])[at["offset"] :][: at["n_bytes"]])[0]["WARC-Refers-To"] == "<urn:page:3>"
    monkeypatch.setattr(warc_bundles, "BROADCAST_ROWS", 0)
    again = warc_bundles.read_bundles(warc_bundles.write_bundles(pages, f"{spark.conf.get('spark.checkpoint.dir')}/warc-shuffled"))
    assert collect(again) == sorted((tuple(r) for r in got), key=str)
    import zstandard

    fs_path = paths[0].removeprefix("file://")
    raw = zstandard.ZstdDecompressor().stream_reader(open(fs_path, "rb"), read_across_frames=True).read()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(none, f"{spark.conf.get('spark.checkpoint.dir')}/warc-none")).count() == 0


# ---- language and quality ----


def test_codewords():
    for n in (2, 4, 6, 9, 40):
        c = language_id.codewords(n)
        assert len({tuple(r) for r in c}) == n and all(abs(col.sum()) < n for col in c.T)


def test_language(spark, odd, empty):
    rng = random.Random(4)
    tongues = {"aa": "lorem ipsum dolor sit amet", "bb": "der die das und nicht", "cc": "uno dos tres por que"}
    rows = [(i, " ".join(rng.choice(tongues[k].split()) for _ in range(20)), k) for i in range(300) for k in [rng.choice(list(tongues))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in language_id.identified(docs, codes).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in rows if i % 2]) > 0.98
    und = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(odd, codes).collect()}
    assert und[20] == und[21] == und[22] == ("und", 0.0) and all(0 <= s <= 1 for _, s in und.values())
    assert language_id.identified(empty, codes).count() == 0
    assert {r["lang_pred"] for r in language_id.identified(docs, language_id.fit(empty)).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.identified(docs, one).collect()} == {"aa"}


def test_decoding_by_brute_force():
    """Language, score and ambiguity from the margins, loss by loss."""
    rng = random.Random(41)
    tongues = {"aa": "lorem ipsum dolor sit", "bb": "der die das und", "cc": "uno dos tres por", "dd": "un deux trois quatre"}
    labels = [rng.choice(list(tongues)) for _ in range(200)]
    texts = [" ".join(rng.choice(tongues[k].split()) for _ in range(15)) for k in labels]
    codes = language_id.Codes(sorted(tongues), labels, np.stack([language_id.count(t) for t in texts]))
    mixed = [" ".join(rng.choice(" ".join(tongues.values()).split()) for _ in range(10)) for _ in range(40)]
    got = list(zip(*codes.predict(mixed), strict=True))
    for text, (lang, score, close) in zip(mixed, got, strict=True):
        x = np.sqrt(language_id.count(text).astype(float))
        x = x / np.sqrt((x * x).sum()) - codes.mean
        margin = [float(sum(x[d] * codes.w[d, b] for d in range(len(x)))) + codes.b[b] for b in range(codes.words.shape[1])]
        loss = {k: sum(codes.weight[b] * max(0.0, 1 - margin[b] * word[b]) ** 2 for b in range(len(margin))) for k, word in zip(codes.langs, codes.words, strict=True)}
        first, second = sorted(loss.values())[:2]
        assert lang == min(loss, key=loss.get) and score == pytest.approx(1 / sum(np.exp(-4 * (v - first)) for v in loss.values()), rel=1e-4)
        assert abs((second - first) - language_id.AMBIGUOUS) < 1e-5 or close == (second - first < language_id.AMBIGUOUS)


def test_too_many_languages(spark, monkeypatch):
    """Labels beyond the bound are an error, not cut off."""
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    docs = lambda n: spark.createDataFrame([(i, f"text of {i % n}", f"l{i % n}") for i in range(20)], "doc_id long, text string, lang string")
    assert language_id.fit(docs(3)).langs == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="lang"):
        language_id.fit(docs(4))


def test_quality_classifier(spark, odd, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80) if i % 4 else " ".join([rng.choice(WORDS) + "***"] * 60), int(i % 4 > 0)) for i in range(240)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2 == 0], "doc_id long, label int")
    model = quality_classifier.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.scored(odd, model).collect())
    assert quality_classifier.scored(empty, model).count() == 0
    assert {r["score"] for r in quality_classifier.scored(odd, quality_classifier.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_votes_by_brute_force():
    """Scores from every cosine, pair by pair."""
    rng = random.Random(42)
    texts = [prose(rng, rng.randint(3, 60)) + ("!!!" if i % 3 else "") for i in range(120)]
    model = quality_classifier.Neighbours([int(i % 3 == 0) for i in range(120)], np.stack([quality_classifier.count(t) for t in texts]))
    asked = [prose(rng, rng.randint(0, 80)) for _ in range(25)]
    for text, score in zip(asked, model.score(asked), strict=True):
        v = (model._weighed(quality_classifier.count(text)[None]) @ model.axes)[0]
        v = v / max(np.sqrt(float(v @ v)), 1e-6)
        cos = sorted(((float(v @ u), y) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        votes = [(max(c, 1e-3) ** quality_classifier.SHARPNESS, y) for c, y in cos[: quality_classifier.NEIGHBOURS]]
        assert score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-3)


# ---- line dedup ----


def brute_lines(docs, words):
    """{(doc_id, copy): line numbers} by comparing all runs."""
    seqs = {k: [(n, x, len(x.split())) for n, x in enumerate((t or "").split("\n")) if x.split()] for k, t in docs}
    seen, gone = {}, {k: set() for k in seqs}
    for k in sorted(seqs, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
        s = seqs[k]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                run = tuple(x for _, x, _ in s[a:b])
                if sum(w for *_, w in s[a:b]) >= words:
                    if run in seen:
                        gone[k] |= {n for n, *_ in s[a:b]}
                    seen.setdefault(run, k)
    return {k: v for k, v in gone.items() if v}


def test_line_dedup(spark, odd, empty):
    rng = random.Random(8)
    pool = [f"line {i} " + " ".join(["w"] * rng.randint(0, 6)) for i in range(12)]
    docs = [((i, 0), "\n".join(rng.choice(pool + ["", "  "]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    df = spark.createDataFrame([(k[0], t) for k, t in docs], "doc_id long, text string")
    got: dict = {}
    for r in line_dedup.repeated(line_dedup.with_copies(df), 10).collect():
        got.setdefault((r["doc_id"], r["copy"]), set()).add(r["line_no"])
    assert got == brute_lines(docs, 10)
    out = {(r["doc_id"]): r["text"] for r in line_dedup.without_repeats(df, 10).collect()}
    assert all(out[k[0]] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got.get(k, ())) for k, t in docs)
    kept = line_dedup.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())
    by = collect(kept.where("doc_id in (23, 24)"), "doc_id", "text")
    assert [t for _, t in by].count("") == 2 and line_dedup.without_repeats(empty).count() == 0


def test_line_dedup_query_by_row(spark, tmp_path):
    """The query counts what is deleted of each row, also of rows that share an id or have none."""
    block = "\n".join(f"line {i} " + "w " * 9 for i in range(6))
    rows = [(1, block), (2, block + "\nown"), (2, "other text"), (None, block), (None, "nothing"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = collect(line_dedup.op5_line_dedup(spark, str(tmp_path)))
    every = "0,1,2,3,4,5"
    assert got == sorted([(1, 6, 0, ""), (2, 7, 6, every), (2, 1, 0, ""), (None, 6, 6, every), (None, 1, 0, ""), (3, 0, 0, "")], key=str)


def test_suffix_array(spark):
    """Order, longest common prefixes and intervals against sorting all suffixes."""
    rng = random.Random(18)
    seqs = {i: [rng.choice("abcd") for _ in range(rng.randint(1, 12))] for i in range(12)} | {20: list("abcabcabcabcabcabc"), 21: list("abcabcabcabcabcabc")}
    docs = spark.createDataFrame([(i, 0, "\n".join(s)) for i, s in seqs.items()], "doc_id long, copy long, text string")
    live = common.written(line_dedup.lines(docs, 8), "test-lines").cache()
    ids = {r["h"] for r in live.collect()}
    rank = {c: k for k, c in enumerate(sorted(ids))}
    code = {(r["doc_id"], r["i"]): rank[r["h"]] for r in live.collect()}
    want = sorted(((tuple(code[d, j] for j in range(i, min(len(s), i + 8))), (d, i)) for d, s in seqs.items() for i in range(len(s))))
    array = line_dedup.suffix_array(live, 8)
    got = sorted(array.collect(), key=lambda r: r["place"])
    assert [(r["doc_id"], r["i"]) for r in got] == [w[1] for w in want]
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    shared = [0] + [8 if a[0] == b[0] else share(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]  # equal to the end: as deep as asked
    assert [min(r["lcp"], 8) for r in got] == shared
    named = line_dedup.intervals(array.withColumn("depths", F.array(*(F.lit(d) for d in (1, 3, 8)))), 8).collect()
    groups: dict = {}
    for r in (r for r in named if r["i"] + r["l"] <= len(seqs[r["doc_id"]])):  # runs end within their document
        groups.setdefault((r["l"], r["interval"]), set()).add((r["doc_id"], r["i"]))
    long_ = {d: {} for d in (1, 3, 8)}
    for seq, at in want:
        for d in long_:
            if len(seq) >= d:
                long_[d].setdefault(seq[:d], set()).add(at)
    for d, g in long_.items():
        assert {frozenset(x) for x in g.values() if len(x) > 1} == {frozenset(v) for (l, _), v in groups.items() if l == d and len(v) > 1}


# ---- n-gram join ----


def brute_groups(docs, k, percent):
    """Shingle sets, and the groups of row numbers."""
    sets = [set(shingles((t or "").encode(), k).tolist()) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                up[top(i)] = top(j)
    groups: dict = {}
    for i in range(len(docs)):
        groups.setdefault(top(i), []).append(i)
    return sets, list(groups.values())


def brute_components(docs, k, percent):
    sets, groups = brute_groups(docs, k, percent)
    return sorted(((docs[i][0], len(sets[i]), min((docs[j][0] for j in g if docs[j][0] is not None), default=None)) for g in groups for i in g), key=str)


def brute_kept(docs, k, percent):
    """One row a group, the one of the smallest doc_id, no id last; which text where ids clash is by hash, so such groups are left to their own test."""
    sets, groups = brute_groups(docs, k, percent)
    return sorted((docs[min(g, key=lambda i: (docs[i][0] is None, docs[i][0] or 0))] for g in groups), key=str)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, k, percent):
    rng = random.Random(9)
    bases, docs = [prose(rng, n) for n in (5, 40, 90, 200)], [(None, "a b c"), (900, "a b c"), (901, "a b"), (902, "A B"), (903, None), (904, ""), (905, "z")]
    for i in range(240):
        words = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "set_id": F.lit(2)})
    assert collect(ngram_join.joined(df, k, percent)) == brute_components(docs, k, percent)
    kept = ngram_join.one_of_each(df, k, percent)
    assert kept.columns == df.columns
    assert collect(kept, "doc_id", "text") == brute_kept(docs, k, percent)


def test_ngram_peels(spark, monkeypatch):
    """Groups that are too much work at once are first tested member by member, to the same end."""
    monkeypatch.setattr(ngram_join, "AT_ONCE", 0)
    monkeypatch.setattr(ngram_join, "PEELS", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    rng = random.Random(10)
    base, docs = prose(rng, 80).split(), []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(80)] = f"e{rng.randrange(4)}"
        docs.append((i, " ".join(words)))
    assert collect(ngram_join.joined(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)) == brute_components(docs, 3, 90)


def test_ngram_heads_are_shuffled_once(spark, monkeypatch):
    """However many shingles heads share, their rows aren't shuffled to be counted and again to be met; the parts add up."""
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    docs = [(i, " ".join(f"w{i}n{j}" for j in range(400))) for i in range(40)]
    docs.append((100, docs[0][1] + " more"))
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(spark._jvm.java.util.ArrayList(), False, False, empty, spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before, most = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large for it
    try:
        assert collect(ngram_join.joined(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)) == brute_components(docs, 3, 90)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    sizes = [len(set(zip(w, w[1:], w[2:], strict=False))) for w in (t.split() for _, t in docs)]
    of_heads = sum(n - (90 * n + 99) // 100 + 1 for n in sizes)
    moved = sum(n for k, n in stages().items() if k not in before and 16 * n > of_heads)  # but for what has few rows
    assert of_heads <= moved < 1.5 * of_heads


@pytest.mark.parametrize("most", [0, 1000])
def test_ngram_null_and_clashing_ids(spark, monkeypatch, most):
    """Sets without doc_id link and bridge; texts that share a doc_id keep their own links."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    rng = random.Random(12)
    docs = [(7, "some other text of no interest"), (None, None), (None, "")]
    for i in range(12):
        words = [prose(rng, 1) + str(rng.random()) for _ in range(100)]
        other = [f"e{i}{j}" for j in range(10)]
        near = [" ".join(w) for w in (words, words[:95] + other[:5], other[5:] + words[5:95] + other[:5])]
        # the first and the last are linked through the middle one alone
        docs += [(None, near[1]), (None, near[1]), (100 + i, near[0]), (200 + i // 4, near[2]), (7, prose(rng, 30))]
    brute = brute_components(docs, 3, 90)
    assert sum(d is not None and c is not None and d != c for d, _, c in brute) >= 12
    assert collect(ngram_join.joined(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)) == brute


def test_one_of_each_loses_no_row(spark):
    """Rows are decided one by one: a doc_id that is dropped with one text stays with another; rows without doc_id are rows."""
    a, b, c = (prose(random.Random(k), 60) for k in (1, 2, 3))
    docs = spark.createDataFrame([(3, a, 0), (5, a, 1), (5, b, 2), (None, c, 3), (None, c, 4), (None, a, 5), (None, "", 6), (None, "", 7), (9, None, 8), (9, None, 9)], "doc_id long, text string, t int")
    kept = collect(ngram_join.one_of_each(docs))
    assert [r[:2] for r in kept if r[1] and r[1] != c] == [(3, a), (5, b)] and [r[1] for r in kept].count(c) == 1
    assert {r[2] for r in kept if not r[1]} == {6, 7, 8, 9} and len(kept) == 7
    # what happens to rows without doc_id doesn't depend on others
    alone = docs.where("doc_id IS NULL AND text <> ''")
    assert len(collect(ngram_join.one_of_each(alone))) == 2


def test_ngram_odd(spark, odd, empty):
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert collect(ngram_join.joined(odd, 3, 90)) == brute_components(docs, 3, 90)
    assert ngram_join.joined(empty, 3, 90).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    up = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in up:
        for a, b in pairs:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert dict(collect(components(df))) == up
    assert components(df.limit(0)).count() == 0


# ---- personal data ----


def slow_spans(text):
    """The fixed patterns as written in the contract."""
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and personal_data.luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("a1+-. ()@b9 40é") for _ in range(rng.randint(0, 60)))
        assert personal_data.base_spans(t) == slow_spans(t), t


def test_field():
    field, rng, hit, miss, wrong = personal_data.trained(), random.Random(99), 0, 0, 0
    for _ in range(150):
        text, truth = personal_data._sentence(rng)
        got = {s for w in personal_data.windows(text) for s in field.best(personal_data.segments(text, w))}
        hit, miss, wrong = hit + len(got & set(truth)), miss + len(set(truth) - got), wrong + len(got - set(truth))
    assert hit / (hit + miss) > 0.93 and hit / (hit + wrong) > 0.95


def segmentations(segs, j=None):
    """All ways to cut words into segments with kinds (0: a word left alone): (i, j, kind, features) lists."""
    j = len(segs) - 1 if j is None else j
    if not j:
        yield []
        return
    for rest in segmentations(segs, j - 1):
        yield [*rest, (j - 1, j, 0, ())]
    for i, a, b, f in segs[j]:
        for rest in segmentations(segs, i):
            for y in range(1, len(personal_data.FOUND) + 1):
                yield [*rest, (i, j, y, f)]


def test_field_against_enumeration():
    """The likelihood, its gradient by features and transitions, and the best segmentation, by listing all segmentations."""
    rng = random.Random(21)
    for text, truth in (("call 555-0143 x", {(5, 3, 13)}), ("a@b.org 10.0.0.1 z", {(0, 0, 7), (8, 1, 16)}), ("key: x=1 9", set())):
        segs = personal_data.segments(text, [m.span() for m in personal_data.WORD.finditer(text)])
        field, names = personal_data.Field(), sorted({x for here in segs for *_, f in here for x in f})
        field.w = [{x: rng.gauss(0, 0.5) for x in names} for _ in personal_data.FOUND]
        field.t = [[rng.gauss(0, 0.5) for _ in row] for row in field.t]
        spans_of = {(i, j): (a, b) for j, here in enumerate(segs) for i, a, b, _ in here}

        def score(path, margin=0.0):
            p, total = 0, 0.0
            for _, _, y, f in path:
                total += field.t[p][y] + (sum(field.w[y - 1].get(x, 0.0) for x in f) - margin if y else 0.0)
                p = y
            return total

        def likelihood():
            paths = list(segmentations(segs))
            z = np.logaddexp.reduce([score(x) for x in paths])
            return next(score(x) for x in paths if {(spans_of[i, j][0], y - 1, spans_of[i, j][1]) for i, j, y, _ in x if y} == truth) - z

        value, dw, dt = field.gradient(segs, truth)
        assert value == pytest.approx(likelihood())
        for p in range(len(field.t)):
            for y in range(len(field.t)):
                field.t[p][y] += 1e-5
                up = likelihood()
                field.t[p][y] -= 1e-5
                assert (up - value) / 1e-5 == pytest.approx(dt[p][y], abs=1e-3)
        for x in names[:: max(1, len(names) // 6)]:
            field.w[3][x] += 1e-5
            up = likelihood()
            field.w[3][x] -= 1e-5
            assert (up - value) / 1e-5 == pytest.approx(dw[3].get(x, 0.0), abs=1e-3)
        allowed = [x for x in segmentations(segs) if all(not y or sum(field.w[y - 1].get(v, 0.0) for v in f) > personal_data.MARGIN for _, _, y, f in x)]
        top = max(allowed, key=lambda x: score(x, personal_data.MARGIN))
        assert field.best(segs) == [(spans_of[i, j][0], y - 1, spans_of[i, j][1]) for i, j, y, _ in top if y]


def test_transitions_are_learnt():
    assert any(abs(v) > 0.1 for row in personal_data.trained().t for v in row)


def test_windows_lose_no_entity():
    """Decoding over windows finds what decoding over all words of the text does."""
    field, rng = personal_data.trained(), random.Random(3)
    decoded = lambda text, runs: [s for w in runs for s in field.best(personal_data.segments(text, w))]
    assert personal_data.spans("7 a john at host dot com", field)[1] == [(4, 0, 24)]
    found = 0
    for _ in range(300):
        text = " ".join(rng.choice(["7", "x=1", "@me", "smith at mill dot org", "jane(at)mill(dot)net", "10.0.0.1"]) + rng.choice([" ", "\n", "\r\n"]) + prose(rng, rng.randint(1, 12)) for _ in range(4))
        whole = decoded(text, [[m.span() for m in personal_data.WORD.finditer(text)]])
        assert decoded(text, personal_data.windows(text)) == whole, text
        found += len(whole)
    assert found > 300


def test_long_words_are_scored():
    """A word is a segment whatever its length; its shape is found in time linear in it."""
    field, rng = personal_data.trained(), random.Random(4)
    for word in ("0123456789abcdef" * 8, "api_key=" + "a1b2c3d4e5" * 12, "0123456789abcdef" * 10_000):
        text = f"the key {word} here"
        assert personal_data.redact(text, personal_data.spans(text, field)[1]) == "the key <secret> here"
    hits = 0
    for _ in range(50_000):
        s = "".join(rng.choice(["at", "dot", "dot", "AT", "DOT", " ", " dot ", "[", "]", "(", ")", "x", "a", "1", ".", "-", "é"]) for _ in range(rng.randint(0, 9)))
        s = rng.choice(["", "x", "x(at)y", "x at y", "x [at] y "]) + s
        full = bool(personal_data.SHAPES["spelt_email"].fullmatch(s))
        assert personal_data.spelt_email(s) == full, s
        hits += full
    assert hits > 1000
    far = "john at " + "host" * 30 + " dot com"
    assert personal_data.redact(far, personal_data.spans(far, field)[1]) == "<email>"
    for s in ("token" * 40_000 + "1", "token" * 40_000 + "=1", "1at" + "dota" * 50_000 + "!", "at" * 100_000 + "1", "x(at)1" + "(dota" * 40_000 + "!", ")" * 200_000 + "1" + ")" * 200_000, "1" + "(" * 200_000):
        personal_data.spans(s, field)


def test_personal_data(spark, odd, empty):
    df = spark.createDataFrame([(1, "write a.b@c-d.org or 10.0.0.1, 4111 1111 1111 1111, +1 (202) 555-0143."), (2, "password=hunter2hunter2 and é +1 (202) 555-0143 4111111111111111"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.personal_data(df).collect()}
    assert [got[1][f"n_{k}"] for k in personal_data.KINDS] == [1, 1, 1, 1] and got[1]["redacted"] == "write <email> or <ip>, <card>, <phone>."
    assert got[1]["base_sha256"] == hashlib.sha256(personal_data.joined(slow_spans(df.first()["text"])).encode()).hexdigest()
    assert "secret:0:23" in got[2]["spans"] and got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert personal_data.personal_data(odd).count() == len(odd_rows()) and personal_data.personal_data(empty).count() == 0


# ---- decontamination ----


def test_decontamination(spark, odd, empty, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(2, 40))) for i in range(25)] + [(30, None), (31, " "), (32, "one"), (33, "two words")]
    docs = [(r[0], r[1]) for r in odd_rows()]
    for i in range(60):
        words = (rng.choice(items[:25])[1]).upper().split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edit"
        docs.append((100 + i, prose(rng, rng.randint(0, 80)) + " " + " ".join(words) + " " + prose(rng, rng.randint(0, 80)) + (" two words one" if i % 9 == 0 else "")))

    def runs(text, k):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, t in items:
        k = min(5, len((t or "").split()))
        q = runs(t, k) if k else set()
        want |= {(d, i, len(q), len(q & runs(x, k))) for d, x in docs if q and 100 * len(q & runs(x, k)) >= 80 * len(q)}
    df, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit(1))
    assert set(collect(decontamination.contaminated(df, b))) == want
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert set(collect(decontamination.contaminated(df, b))) == want
    assert {r["doc_id"] for r in decontamination.without_contaminated(df, b).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    # rows without doc_id, and two texts of one doc_id, are decided by text
    bad, clean = " ".join(items[3][1].split()) + " " + prose(rng, 20), prose(rng, 40)
    rows = [(None, bad), (None, clean), (7, bad), (7, clean), (8, bad), (8, bad)]
    lone = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(decontamination.without_contaminated(lone, b), "doc_id", "text") == sorted([(None, clean), (7, clean)], key=str)
    assert Counter(r["doc_id"] for r in decontamination.contaminated(lone, b.where("item_id = 3")).collect()) == {None: 1, 7: 1, 8: 1}
    assert decontamination.contaminated(empty, b).count() == 0 and decontamination.contaminated(df, b.limit(0)).count() == 0
    assert decontamination.without_contaminated(odd, b).columns == odd.columns


def test_signatures(spark):
    """Partitions have one length of signature, and no document that has its share of an item is missed before the exact test."""
    rng = random.Random(13)
    sizes = [1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 40, 63, 64, 100, 150, 255, 300]
    sets = [sorted({rng.randint(-(1 << 62), 1 << 62) for _ in range(q)}) for q in sizes]
    items = spark.createDataFrame(list(enumerate(sets)), "item_id long, shingles array<long>")
    signed = {r["item_id"]: r for r in decontamination.signatures(items, 80).collect()}
    for i, q in enumerate(sizes):
        r, most = signed[i], (1 << q.bit_length()) - 1
        assert r["partition"] == q.bit_length() - 1 and r["signature"] == sets[i][: most // 5 + 1 + decontamination.EXTRA] and r["need"] == len(r["signature"]) - q // 5 >= 1
    sketch = decontamination.signatures(items, 80).select("item_id", "need", F.explode("signature").alias("h"))
    has, near, docs = set(), set(), []
    for i, q in enumerate(sizes):
        for d in range(8):
            kept = rng.sample(sets[i], rng.randint(max(1, q // 2), q))
            docs.append((100 * i + d, 0, kept))
            (has if 5 * len(kept) >= 4 * q else near).add((100 * i + d, i))
    hashed = spark.createDataFrame(docs, "doc_id long, t long, hs array<long>").select("doc_id", "t", F.explode("hs").alias("h"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.candidates(hashed, sketch).collect()}
    assert has <= found and len(found & near) < len(near)


# ---- quality rules ----


def test_quality_rules(spark, odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.judged(odd).select("doc_id", "measures_.*", quality_rules.verdict().alias("kept")).collect() if r["doc_id"] is not None}
    for doc_id, text, *_ in odd_rows():
        if doc_id is None:
            continue
        w, r = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x], got[doc_id]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        ls = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(marked), len(ls) - len(set(ls))), doc_id
    assert not got[20]["kept"] and not got[21]["kept"] and not got[22]["kept"]
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns


def test_quality_rules_catch_junk(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 150)) for i in range(80)] + [(100 + i, " ".join(w + "***" for w in prose(rng, 150).split())) for i in range(8)] + [(200 + i, prose(rng, 150).upper().replace(".", "")) for i in range(6)] + [(300, "again and again " * 60)]
    kept = {r["doc_id"] for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(80))


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    """Each stage against what it should keep, on a folder of small tables."""
    import corpus_pipeline

    rng = random.Random(15)
    item = prose(rng, 30)
    docs = [(i, prose(rng, 200), "en", f"s{i % 2}", 1) for i in range(40)] + [(50, None, "en", "s0", 0), (51, "short", "en", "s0", 5)]
    docs += [(60 + i, " ".join(["x" + docs[i][1].split()[0], *docs[i][1].split()[1:]]), "en", "s0", 1) for i in range(5)] + [(70, prose(rng, 100) + " " + item + " " + prose(rng, 60), "en", "s1", 1)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns, name
        df = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r["doc_id"] for r in df.collect()})
    assert kept[0] == {d[0] for d in docs} - {50, 51} and kept[1] == kept[0] - {60, 61, 62, 63, 64} and kept[2] == kept[1] - {70}
    mix = Counter(r["doc_id"] for r in df.collect())
    assert set(mix) <= kept[2] and max(mix.values()) <= 2
    tokens = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in tokens) == mix and sum(r["n_tokens"] for r in tokens) == max(r["start"] + r["n_tokens"] for r in tokens)
