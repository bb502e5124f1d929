"""Operator 6: byte-level BPE by a minimal acyclic transducer, with exact merging of unseen words.

Spark counts the corpus's space-separated chunks; the frequent ones give the
lexicon's words, encoded once with the merge rules.  The lexicon is compiled
into a minimal acyclic automaton: states with equal futures are one state
(shared suffixes), and each arc carries the number of words ordered before
it, so the sum along a path is the word's number, whose ids lie in one
array.  The compiled arrays are one file in the shared folder, which Spark
hands to every executor (``addFile``) and tasks memory-map.  Words outside
the lexicon are merged exactly by the merge rules, all words of a batch at a
time in numpy.

The lexicon's size is bounded by ``LEXICON_WORDS`` (it only decides what is
looked up rather than merged).  Defined results: null text is empty (no ids,
the hash of nothing); the special token's string in a text is its id, as in
the tokenizers library; texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import slices, text_buffer
from ._store import documents, new_path, saved

#: Words in the lexicon at most, and the longest that enters it (bytes).
LEXICON_WORDS = 60_000
LONGEST = 48
#: Words kept by a worker between batches at most; results do not depend on it.
CACHE_WORDS = 300_000
#: Fixed value: the pattern that splits text before byte-level merges.
_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same split for texts of which every character is an ASCII letter, digit, mark or space.
_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_RUN = re.compile(r"  ")


def byte_chars() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The vocabulary and merge rules of a byte-level tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in t)
        for t, i in self.specials.items():
            self.token_bytes[i] = t.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Open addressing, so that a rank is found in a few array reads.
        self.mask = (1 << 18) - 1
        while 4 * len(keys) > self.mask:
            self.mask = 2 * self.mask + 1
        self.keys, self.ranks = np.full(self.mask + 1, ~np.uint64(0)), np.full(self.mask + 1, len(keys), np.int64)
        self.made, self.none = np.append(made, 0), len(keys)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == ~np.uint64(0)]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.ranks[slot[first]] = keys[first], first
            todo = np.setdiff1d(todo, first, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; ``none`` where the pair has none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], self.none)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != ~np.uint64(0)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (here != ~np.uint64(0))]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids a word, ids): the pair of lowest rank in a word merges first, everywhere from the left, until none is left."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes)
        done_of, done_ids = [], []
        while len(ids):
            rank = np.full(len(ids), self.none)
            pair = np.flatnonzero(of[:-1] == of[1:])
            rank[pair] = self.rank(ids[pair], ids[pair + 1])
            start = np.flatnonzero(np.diff(of, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            count = np.diff(np.append(start, len(of)))
            over = np.repeat(low == self.none, count)
            done_of.append(of[over])
            done_ids.append(ids[over])
            go = ~over & (rank == np.repeat(low, count))
            at = np.flatnonzero(go)
            if len(at):  # in a run of overlapping pairs (aaa), every other one merges, from the left
                run = np.cumsum(np.diff(at, prepend=-2) != 1)
                place = np.arange(len(at)) - np.searchsorted(run, run)
                skip = at[place % 2 == 1]
                go[skip] = False
                at = np.flatnonzero(go)
                ids = ids.copy()
                ids[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            ids, of = ids[keep], of[keep]
        of, ids = np.concatenate(done_of or [sizes[:0]]), np.concatenate(done_ids or [sizes[:0]])
        order = np.argsort(of, kind="stable")
        return np.bincount(of, minlength=len(words)), ids[order].astype(np.uint32)


def split(text: str) -> list[str]:
    return _ASCII.findall(text) if text.isascii() and not _ODD_SPACE.search(text) else _PATTERN.findall(text)


# -- the automaton ---------------------------------------------------------------------------------------------------


def compile_lexicon(words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Minimal acyclic automaton of sorted ``words`` with numbers on its arcs, and their ids, as one file."""
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int, int], ...]] = []  # per state: (byte, target, words before)
    finals: list[int] = []
    counts: list[int] = []

    def freeze(final: int, out: list[list[int]]) -> int:
        key = (final, *[(b, t) for b, t in out])
        if key not in register:
            before, row = final, []
            for b, t in out:
                row.append((b, t, before))
                before += counts[t]
            register[key] = len(arcs)
            arcs.append(tuple(row))
            finals.append(final)
            counts.append(before)
        return register[key]

    path: list[list] = [[0, []]]  # the states of the current word that may still change: [final, arcs]
    last = b""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            final, out = path.pop()
            path[-1][1][-1][1] = freeze(final, out)
        for b in w[common:]:
            path[-1][1].append([b, -1])
            path.append([0, []])
        path[-1][0] = 1
        last = w
    while len(path) > 1:
        final, out = path.pop()
        path[-1][1][-1][1] = freeze(final, out)
    root = freeze(*path[0])
    flat = [a for row in arcs for a in row]
    first = np.cumsum([0, *map(len, arcs)])
    symbols = np.array([(s << 8) | a[0] for s, row in enumerate(arcs) for a in row], np.int64)
    target, before = (np.array([a[k] for a in flat], np.int64) for k in (1, 2))
    # Transitions by hashing (state, byte): one array read per step and word.
    bits = 4
    while (1 << bits) < 4 * len(flat) + 4:
        bits += 1
    table, slot = np.full(1 << bits, -1, np.int64), ((symbols * 0x9E3779B1) >> 7) & ((1 << bits) - 1)
    for k, s in enumerate(slot.tolist()):
        while table[s] >= 0:
            s = (s + 1) & ((1 << bits) - 1)
        table[s] = k
    id_start = np.cumsum(sizes) - sizes
    del first
    parts = [table, symbols, target, before, np.array(finals, np.int64), id_start.astype(np.int64), sizes.astype(np.int64), ids.astype(np.int64)]
    head = struct.pack("<3q8q", 1, root, bits, *map(len, parts))
    return head + b"".join(p.astype("<i8").tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i8", "r")
        _, self.root, self.bits = (int(x) for x in data[:3])
        parts, pos = [], 11
        for n in data[3:11].tolist():
            parts.append(data[pos : pos + n])
            pos += n
        self.table, self.symbols, self.target, self.before, self.finals, self.id_start, self.sizes, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for those outside; all words walk the automaton together, a byte at a time."""
        out = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        if not len(self.symbols):
            return out
        alive = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        state, total, mask = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64), (1 << self.bits) - 1
        for depth in range(LONGEST + 1):
            end = sizes[alive] == depth
            ok = end & (self.finals[state] == 1)
            out[alive[ok]] = total[ok]
            alive, state, total = alive[~end], state[~end], total[~end]
            if not len(alive):
                break
            symbol = (state << 8) | data[at[alive] + depth]
            slot = ((symbol * 0x9E3779B1) >> 7) & mask
            arc = self.table[slot]
            seek = np.flatnonzero((arc >= 0) & (self.symbols[arc] != symbol))
            while len(seek):
                slot[seek] = (slot[seek] + 1) & mask
                arc[seek] = self.table[slot[seek]]
                seek = seek[(arc[seek] >= 0) & (self.symbols[arc[seek]] != symbol[seek])]
            live = arc >= 0
            alive, state, total = alive[live], self.target[arc[live]], total[live] + self.before[arc[live]]
        return out


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, _ = text_buffer(b.column("text"))
        for i, j in slices(offsets, 8 << 20):
            got: Counter[str] = Counter()
            for t in b.column("text").slice(i, j - i).fill_null("").to_pylist():
                got.update(t.split(" "))
            yield pa.record_batch([pa.array(got.keys(), pa.string()), pa.array(got.values(), pa.int64())], names=["chunk", "n"])


def frequent_chunks(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """About ``limit`` of the most frequent chunks, never more; all of them where there are fewer.

    The threshold comes from the histogram of counts over the whole corpus; of the step that it cuts, chunks are taken by hash.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_chunk_counts, "chunk string, n long")
    counts = rows.groupBy("chunk").agg(F.sum("n").alias("n")).where(f"n > 1 and octet_length(chunk) between 1 and {LONGEST - 1}")
    # Above 4096 a step is a tenth: at most 4096 and some 370 steps come to the driver.
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log(F.col("n") / 4096) / F.log(F.lit(1.1))))
    counts = counts.withColumn("step", step)
    path = new_path(docs.sparkSession, "chunk-counts")
    counts.write.parquet(path)
    counts = docs.sparkSession.read.schema(counts.schema).parquet(path)
    hist = sorted(((r.step, r.m) for r in counts.groupBy("step").agg(F.count("*").alias("m")).collect()), reverse=True)
    total, taken = 0, F.lit(True)
    for s, m in hist:
        if total + m > limit:
            taken = (F.col("step") > s) | (F.col("step") == s) & (F.pmod(F.xxhash64("chunk"), F.lit(m)) < limit - total)
            break
        total += m
    chosen = sorted((-r.step, r.chunk) for r in counts.where(taken).select("step", "chunk").collect())
    return sorted(c for _, c in chosen[:limit])


def build_lexicon(chunks: list[str], merges: Merges) -> bytes:
    words: set[bytes] = set()
    for c in chunks:
        for w in (c, " " + c):
            words.update(x.encode("utf-8") for x in split(w))
    ordered = sorted(w for w in words if len(w) <= LONGEST)
    return compile_lexicon(ordered, *merges.merge(ordered))


def _share(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` to the shared folder and have Spark bring it to every executor; its name there."""
    path = new_path(spark, "lexicon")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


class Encoder:
    """Encodes texts through a lexicon; chunks already split and words already merged are kept."""

    def __init__(self, tokenizer: str, lexicon: str):
        self.merges, self.lexicon = Merges(tokenizer), Lexicon(lexicon)
        self._special = re.compile("|".join(map(re.escape, self.merges.specials))) if self.merges.specials else None
        self.clear()

    def clear(self) -> None:
        self.word_of: dict[str, int] = {}
        self.chunk_of: dict[str, tuple[int, ...]] = {}
        self.size, self.start, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _add(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        number = self.lexicon.numbers(raw)
        size = np.zeros(len(raw), np.int64)
        hit, miss = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        size[hit] = self.lexicon.sizes[number[hit]]
        merged, values = self.merges.merge([raw[k] for k in miss])
        size[miss] = merged
        start = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.uint32)
        for rows, base, source in ((hit, self.lexicon.id_start[number[hit]], self.lexicon.ids), (miss, np.cumsum(merged) - merged, values)):
            n = size[rows]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(start[rows], n) + step] = source[np.repeat(base, n) + step]
        self.size, self.start = np.append(self.size, size), np.append(self.start, self.used + start)
        self.ids, self.used = np.append(self.ids, ids), self.used + len(ids)

    def _words(self, text: str, head: bool, out: list, fresh: list) -> None:
        """Append the word numbers of a piece of text that no other piece touches."""
        word_of = self.word_of
        for w in split(text if head else " " + text):
            k = word_of.get(w)
            if k is None:
                k = word_of[w] = len(word_of)
                fresh.append(w)
            out.append(k)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        if len(self.word_of) + len(self.chunk_of) > CACHE_WORDS:
            self.clear()
        chunk_of, fresh = self.chunk_of, []
        numbers: list[int] = []
        bounds, special = [0], []
        for t in texts:
            parts, marks = [t], []
            if self._special and self._special.search(t):
                parts, marks = self._special.split(t), self._special.findall(t)
            for p, part in enumerate(parts):
                if p:
                    special.append((len(numbers), self.merges.specials[marks[p - 1]]))
                    numbers.append(-1)
                if not part:
                    continue
                if "  " in part or not part.isascii() and _ODD_SPACE.search(part):
                    self._words(part, True, numbers, fresh)  # runs of spaces are split as a whole
                    continue
                first, *rest = part.split(" ")
                if first:
                    self._words(first, True, numbers, fresh)
                for c in rest:  # each with the space before it
                    got = chunk_of.get(c)
                    if got is None:
                        got = []
                        self._words(c, False, got, fresh)
                        got = chunk_of[c] = tuple(got)
                    numbers += got
            bounds.append(len(numbers))
        if fresh:
            self._add(fresh)
        at = np.array(numbers, np.int64)
        mark = at < 0
        if mark.any():  # a special token is a word of one id at the end of the arrays
            own = np.array([i for _, i in special], np.uint32)
            start, size, ids = np.append(self.start, self.used + np.arange(len(own))), np.append(self.size, np.ones(len(own), np.int64)), np.append(self.ids, own)
            at[mark] = len(self.start) + np.arange(len(own))
        else:
            start, size, ids = self.start, self.size, self.ids
        n = size[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        flat = ids[np.repeat(start[at] - upto[:-1], n) + np.arange(upto[-1])]
        return flat, np.diff(upto[np.array(bounds)])


class Decoder:
    """Texts of ids, by the tokens' bytes."""

    def __init__(self, tokenizer: str):
        tokens = Merges(tokenizer).token_bytes
        self.token_size = np.fromiter(map(len, tokens), np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids: the tokens' bytes joined, read as UTF-8."""
        n = self.token_size[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        data = self.token_data[np.repeat(self.token_start[ids] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        ends = upto[np.concatenate(([0], np.cumsum(lens)))].tolist()
        return [data[a:z].decode("utf-8", "replace") for a, z in zip(ends, ends[1:], strict=False)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def encode_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids."""
    name = _share(docs.sparkSession, build_lexicon(frequent_chunks(docs), Merges(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, name)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(tokenizer, SparkFiles.get(name))
        enc = _ENCODERS[key]
        for b in batches:
            offsets, _ = text_buffer(b.column("text"))
            for i, j in slices(offsets):
                ids, lens = enc.encode(b.column("text").slice(i, j - i).fill_null("").to_pylist())
                upto = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(upto, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _decode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # encoding is over: its caches would only take room beside the texts
        if tokenizer not in _DECODERS:
            _DECODERS[tokenizer] = Decoder(tokenizer)
        for b in batches:
            ids = b.column("ids")
            lens = np.diff(ids.offsets.to_numpy())
            texts = _DECODERS[tokenizer].decode(ids.flatten().to_numpy(), lens)
            yield pa.record_batch([b.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def _digests(decoded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in decoded:
        ids = b.column("ids")
        lens = np.diff(ids.offsets.to_numpy())
        view, ends = memoryview(ids.flatten().to_numpy().astype("<u4")).cast("B"), np.cumsum(lens).tolist()
        digest = [hashlib.sha256(view[4 * a : 4 * z]).hexdigest() for a, z in zip([0, *ends], ends, strict=False)]
        back = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in b.column("text").to_pylist()]
        cols = [b.column("doc_id"), pa.array(lens, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
        yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def decode_ids(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of rows (doc_id, ids): doc_id, ids, text."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(tokenizer), "doc_id long, ids array<int>, text string")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, of the written ids and the texts they decode to."""
    decode = _decode(tokenizer)
    rows = saved(encode_ids(docs, tokenizer), "ids")  # one Python worker decodes and digests
    return rows.mapInArrow(lambda it: _digests(decode(it)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
