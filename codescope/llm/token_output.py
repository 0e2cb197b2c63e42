"""Token-ID output: one wavelet matrix per shard.

Documents are dealt by range of doc_id into shards. A shard is one file: the ids of its documents, an end id after
each, as a wavelet matrix of 16 bit-planes (a shard of more than SEGMENT ids has several). Every plane is a zstd frame with
a rank directory, so access, counting and occurrence lookup decompress only the planes they touch.

Defined results: a null text counts as empty (end id alone); null doc_ids come first; documents that share a doc_id
follow each other in order of text; repeated rows are written each; very long texts are encoded whole, one at a time; an
empty table gives no shard and no row; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from bisect import bisect_left
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attempt_name, filesystem, pieces, scratch, table, write_file, written

MAGIC = b"CSWAVE01"
BITS = 16
SEGMENT = 1 << 24  # ids of one matrix: all of a shard, unless few or equal doc_ids make it larger than shards are meant to be
PIECE = 8 << 20  # bytes of text that are encoded at once, more only where one text has more
BLOCK = 512  # bits between entries of the rank directory
END_ID = 2
ID_OF = attrgetter("id")
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with a tokenizer whose pre-tokenizer never crosses white space, which drops white space and
    lower-cases, by words, with a cache of words: the ids of a text are those of its words in turn. Words of ASCII and Latin-1
    small letters are cut into pre-tokens here; all others are given to the library whole."""

    #: Words whose pre-tokens PIECES finds.
    is_plain = re.compile(rb"(?:[!-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
    is_letters = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
    #: The pre-tokenizer's pattern over such words. Fixed values.
    PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")
    _made: dict = {}

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.t, self.most, self.cache = Tokenizer.from_file(path), most, {b"": b""}
        vocab = self.t.get_vocab()
        if max(vocab.values()) >= 1 << BITS:
            raise ValueError(f"ids of {path} need more than {BITS} bits")
        chars = ByteLevel(add_prefix_space=False, use_regex=False)  # the characters that the model sees for bytes over 127
        self.of_word = self.t.model.tokenize
        self.letters = {b: chars.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in (*range(0x9F, 0xB7), *range(0xB8, 0xC0))}

    def forget(self) -> None:
        self.cache = {b"": b""}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _letters(self, words: list[bytes]) -> None:
        """Learns words of letters alone, each of which is one pre-token."""
        ids, stops, held = [], [0], gc.isenabled()
        gc.disable()  # many short-lived objects, none in a cycle
        words = sorted(words, key=bytes.isascii)
        ascii_ = bisect_left(words, True, key=bytes.isascii)
        wide, narrow = b"\n".join(words[:ascii_]).decode("latin-1").translate(self.letters), b"\n".join(words[ascii_:]).decode()
        for tokens in map(self.of_word, [*(wide.split("\n") if wide else []), *(narrow.split("\n") if narrow else [])]):
            ids.extend(map(ID_OF, tokens))
            stops.append(2 * len(ids))
        if held:
            gc.enable()
        raw = np.array(ids, "<u2").tobytes()
        self.cache.update(zip(words, [raw[i:j] for i, j in zip(stops, stops[1:], strict=False)], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        letters, plain, rest = [], [], []
        for w in new:
            (letters if self.is_letters(w) else plain if self.is_plain(w) else rest).append(w)
        cut = [self.PIECES.findall(w) for w in plain]
        more = set().union(*cut).difference(self.cache, letters)
        letters += [p for p in more if self.is_letters(p)]
        if letters:
            self._letters(letters)
        for p in more:
            if p not in self.cache:
                self.cache[p] = np.array([x.id for x in self.of_word(p.decode())], "<u2").tobytes()
        get = self.cache.__getitem__
        for w, pieces_ in zip(plain, cut, strict=True):
            self.cache[w] = b"".join(map(get, pieces_))
        for lo in range(0, len(rest), 5000):
            part = rest[lo : lo + 5000]
            for w, e in zip(part, self.t.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, dtype="<u2").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. texts: strings without null."""
        special = pc.match_substring(texts, "<|")  # may spell a special token, which is matched before lower-casing
        if pc.any(special).as_py():
            alone = np.flatnonzero(special.to_numpy(zero_copy_only=False))
            ids, sizes = self.encode(pc.if_else(special, "", texts))
            parts, at = np.split(ids, np.cumsum(sizes)[:-1]), alone.tolist()
            for k, text in zip(at, texts.take(pa.array(alone)).to_pylist(), strict=True):
                parts[k] = np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint16)
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = words.flatten().dictionary_encode()
        stops = words.offsets.to_numpy() - words.offsets[0].as_py()
        del words
        distinct = flat.dictionary.cast(pa.binary()).to_pylist()
        codes = flat.indices.to_numpy()
        get = self.cache.get
        found = [get(w) for w in distinct]
        if None in found:
            new = [w for w, x in zip(distinct, found, strict=True) if x is None]
            if len(self.cache) + len(new) > self.most:
                self.forget()
                new = [w for w in distinct if w]
            self._learn(new)
            found = list(map(self.cache.__getitem__, distinct))
        of_word = np.fromiter(map(len, found), np.int32, len(found)) >> 1
        all_ids = np.frombuffer(b"".join(found), "<u2")
        starts = np.cumsum(of_word, dtype=np.int32) - of_word
        del flat, distinct, found
        n = of_word[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat(starts[codes] - ends[:-1].astype(kind), n)
        at += np.arange(ends[-1], dtype=kind)
        return all_ids[at], np.diff(ends[stops])


def build_segment(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The bit-planes (packed, highest bit first, each stably split by the planes before it) and their counts of zeros."""
    planes, zeros, n = [], [], len(ids)
    spare = [np.empty_like(ids), np.empty_like(ids)]
    for bit in range(BITS - 1, -1, -1):
        one = ((ids >> np.uint16(bit)).astype(np.uint8) & np.uint8(1)).view(bool)
        planes.append(np.packbits(one).tobytes())
        zeros.append(n - int(np.count_nonzero(one)))
        to = spare[bit % 2]
        np.compress(~one, ids, out=to[: zeros[-1]])
        np.compress(one, ids, out=to[zeros[-1] :])
        ids = to
    return planes, zeros


def restore_segment(planes: list[bytes], zeros: list[int], n: int) -> np.ndarray:
    """All ids of a segment in their order: the splits are undone from the last plane to the first."""
    ids = np.zeros(n, dtype=np.uint16)
    for level in range(BITS - 1, -1, -1):
        one = np.unpackbits(np.frombuffer(planes[level], np.uint8), count=n).view(bool)
        up = np.empty_like(ids)
        up[np.flatnonzero(~one)] = ids[: zeros[level]]
        up[np.flatnonzero(one)] = ids[zeros[level] :] | np.uint16(1 << (BITS - 1 - level))
        ids = up
    return ids


class ShardWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.pending, self.held, self.segments = out, [], 0, []
        self.doc_ids, self.known, self.lengths, self.z = [], [], [], zstandard.ZstdCompressor(level=1)
        out.write(MAGIC)

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with the sizes of theirs among ids."""
        self.doc_ids += [x or 0 for x in doc_ids]
        self.known += [x is not None for x in doc_ids]
        self.lengths += sizes.tolist()
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= SEGMENT:
            ids = np.concatenate(self.pending)
            while len(ids) >= SEGMENT:
                self._segment(ids[:SEGMENT])
                ids = ids[SEGMENT:]
            self.pending, self.held = [ids], len(ids)

    def _segment(self, ids: np.ndarray) -> None:
        planes, zeros = build_segment(ids)
        at = []
        for p in planes:
            ones = np.bitwise_count(np.frombuffer(p.ljust(-(-len(p) // (BLOCK // 8)) * (BLOCK // 8), b"\0"), np.uint8)).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4").tobytes() if len(ones) else b""
            frames = [self.z.compress(p), self.z.compress(ranks)]
            at.append((self.out.tell(), len(frames[0]), len(frames[1])))
            for f in frames:
                self.out.write(f)
        self.segments.append((len(ids), zeros, at))

    def close(self) -> None:
        if self.held:
            self._segment(np.concatenate(self.pending))
        foot = [struct.pack("<II", len(self.segments), len(self.doc_ids))]
        for n, zeros, at in self.segments:
            foot.append(struct.pack(f"<Q{BITS}Q", n, *zeros) + b"".join(struct.pack("<QII", *x) for x in at))
        foot += [np.array(self.doc_ids, "<i8").tobytes(), np.array(self.known, np.uint8).tobytes(), np.array(self.lengths, "<u8").tobytes()]
        raw = self.z.compress(b"".join(foot))
        self.out.write(raw + struct.pack("<Q", len(raw)) + MAGIC)


class Shard:
    """Reads a shard file: documents in turn, or single positions, counts and occurrences by rank and select."""

    def __init__(self, uri: str):
        import zstandard

        self.z = zstandard.ZstdDecompressor()
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        tail = self.f.read_at(16, size - 16)
        if bytes(tail[8:]) != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        (n,) = struct.unpack("<Q", tail[:8])
        foot = self.z.decompress(self.f.read_at(n, size - 16 - n))
        segments, docs = struct.unpack_from("<II", foot)
        at, self.segments = 8, []
        for _ in range(segments):
            n, *zeros = struct.unpack_from(f"<Q{BITS}Q", foot, at)
            at += 8 * (BITS + 1)
            self.segments.append((n, zeros, [struct.unpack_from("<QII", foot, at + 16 * k) for k in range(BITS)]))
            at += 16 * BITS
        self.doc_ids = np.frombuffer(foot, "<i8", docs, at)
        self.known = np.frombuffer(foot, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(foot, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.n = sum(s[0] for s in self.segments)
        self._planes: dict = {}

    def _plane(self, s: int, level: int):
        if (s, level) not in self._planes:
            if len(self._planes) > 4 * BITS:
                self._planes.clear()
            at, a, b = self.segments[s][2][level]
            self._planes[s, level] = np.frombuffer(self.z.decompress(self.f.read_at(a, at)), np.uint8), np.frombuffer(self.z.decompress(self.f.read_at(b, at + a)) if b else b"", "<u4")
        return self._planes[s, level]

    def _rank(self, s: int, level: int, i: int) -> int:
        """Ones before bit i."""
        bits, ranks = self._plane(s, level)
        if i >= self.segments[s][0]:
            return self.segments[s][0] - self.segments[s][1][level]
        k = i // BLOCK
        rest = bits[k * BLOCK // 8 : i // 8 + 1].copy()
        rest[-1] &= (0xFF00 >> (i % 8)) & 0xFF
        return int(ranks[k]) + int(np.bitwise_count(rest).sum(dtype=np.int64))

    def _place(self, i: int) -> tuple[int, int]:
        for s, (n, _, _) in enumerate(self.segments):
            if i < n:
                return s, i
            i -= n
        raise IndexError(i)

    def access(self, i: int) -> int:
        """The id at position i of the shard."""
        s, i = self._place(i)
        out = 0
        for level in range(BITS):
            bits, _ = self._plane(s, level)
            one = bits[i // 8] >> (7 - i % 8) & 1
            r = self._rank(s, level, i)
            i = self.segments[s][1][level] + r if one else i - r
            out = out << 1 | int(one)
        return out

    def _range(self, s: int, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(BITS):
            a, b = self._rank(s, level, lo), self._rank(s, level, hi)
            zeros = self.segments[s][1][level]
            lo, hi = (zeros + a, zeros + b) if token >> (BITS - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Times that token stands at positions from lo and before hi."""
        hi, at, out = self.n if hi is None else hi, 0, 0
        for s, (n, _, _) in enumerate(self.segments):
            a, b = max(lo - at, 0), min(hi - at, n)
            if a < b:
                x, y = self._range(s, token, a, b)
                out += y - x
            at += n
        return out

    def _select(self, s: int, level: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.segments[s][0]
        while lo < hi:  # the first i with more than k before i + 1
            mid = (lo + hi) // 2
            r = self._rank(s, level, mid + 1)
            if (r if one else mid + 1 - r) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def occurrences(self, token: int):
        """The positions of token, ascending."""
        at = 0
        for s, (n, zeros, _) in enumerate(self.segments):
            lo, hi = self._range(s, token, 0, n)
            found = []
            for i in range(lo, hi):
                for level in range(BITS - 1, -1, -1):
                    one = bool(token >> (BITS - 1 - level) & 1)
                    i = self._select(s, level, one, i - zeros[level] if one else i)
                found.append(at + i)
            yield from sorted(found)
            at += n

    def documents(self):
        """(doc_id, ids) in file order; one segment at a time is held."""
        left, s = np.zeros(0, np.uint16), 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            while len(left) < n:
                size, zeros, at = self.segments[s]
                first, total = at[0][0], at[-1][0] + at[-1][1] - at[0][0]
                raw = memoryview(self.f.read_at(total, first))
                left = np.concatenate([left, restore_segment([self.z.decompress(raw[o - first : o - first + a]) for o, a, _ in at], zeros, size)])
                s += 1
            yield (doc_id if known else None), left[:n]
            left = left[n:]


def write_shards(docs: DataFrame, out_dir: str, shards: int, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards in ascending order of doc_id under out_dir.
    Returns the manifest, a table in the shared folder: shard, path, n_docs, n_tokens, bytes."""
    path = tokenizer or tokenizer_path()

    def write(batches):
        from pyspark import TaskContext

        name, total = f"{out_dir}/{attempt_name('shard')}.wave", [0, 0]

        def fill(out):
            w, enc = ShardWriter(out), Encoder.of(path)
            for b in batches:
                for part in pieces(b, 1, PIECE):
                    ids, sizes = enc.encode(pc.fill_null(part.column(1), ""))
                    pa.default_memory_pool().release_unused()
                    w.add(part.column(0).to_pylist(), sizes + 1, np.insert(ids, np.cumsum(sizes), end_id))
            w.close()
            total[:] = len(w.lengths), sum(w.lengths)
            enc.forget()  # the worker outlives the task
            pa.default_memory_pool().release_unused()

        first = next(batches, None)
        if first is None:
            return
        batches = (b for src in ([first], batches) for b in src)
        size = write_file(name, fill)
        if total[0]:
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [name], "n_docs": [total[0]], "n_tokens": [total[1]], "bytes": [size]})

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, bytes long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, shard, in the order of the shards."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("start"))
    n = max(1, manifest.count())

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                at, cols = row["start"], ([], [], [], [])
                for doc_id, ids in Shard(row["path"]).documents():
                    for c, v in zip(cols, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([row["shard"]] * len(cols[0]), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def shard_count(docs: DataFrame, shard_bytes: int) -> int:
    """Shards of about shard_bytes of text each."""
    total = docs.select(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0)).alias("b")).first()["b"]
    return max(1, -(-int(total) // shard_bytes))


def tokenise(spark: SparkSession, docs: DataFrame, shard_bytes: int = 16 << 20) -> DataFrame:
    return read_shards(write_shards(docs, scratch(spark, "token-shards"), shard_count(docs, shard_bytes)))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(spark, table(spark, sf_dir, "documents"))
