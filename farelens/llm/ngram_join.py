"""Operator 8: n-gram Jaccard join over parity sketches.

A document's set holds its distinct 5-word shingles.  Two sets of sizes
a <= b with similarity 0.8 or more have b <= 1.25 a and differ in at most
D(a) = floor((a + floor(1.25 a)) / 9) shingles.  Shingles are dealt by hash
to more than D(a) blocks, and each block keeps the XOR of its shingles'
64-bit hashes: the number of blocks whose XOR differs is a Hamming distance
that never exceeds the symmetric difference.  So by the pigeonhole principle
some block agrees, and documents meet by (size band, block, XOR).  Blocks
without shingles agree for any two documents and are left out; that is exact
for documents with more than D filled blocks, and the rest (``weak``, which
random hashing makes rare) are compared with all documents of their sizes.

Block keys travel as packed binary columns to hash buckets, where they are
sorted.  A small group of a key gives all its pairs; a large one gives each
member's pair with a centre, and is kept.  Candidates whose one-bit parity
sketches are near enough (same bound) are verified on whole sets.  Then every kept group whose members still lie in different components
is searched again, a pair of slices at a time, in a task that holds their
sketches and sets: cross-component pairs that pass the one-bit parity sketch
(same bound) are compared by their whole sets, unless links found before join
them already.  A task emits a spanning forest, fewer links than it has
members, and no link that could join two components is lost.

Equal sets are one class, told by a 128-bit hash of the set.

Defined results: null text or one without words has the empty set and links
with nothing; fewer than five words are one shingle; rows that repeat a
doc_id are one document; rows with a null doc_id are returned, unlinked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import BASE, U, lighten, mix, slices, text_buffer, word_hashes
from ._graph import components
from ._store import as_struct, documents, saved, shuffle_width

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets up to this size give every shingle a block of its own.
TINY = 16
#: Members of a key up to which all pairs are candidates at once; centres a larger group may choose from.
SMALL, CENTRES = 8, 4
#: Block keys a bucket holds, about.
BUCKET_KEYS = 500_000
#: Partners of one centre that one task verifies.
PARTNERS = 400
#: Members and bytes of shingles of a slice of an open group, about; a task compares two slices.
SLICE, SLICE_BYTES = 1000, 8 << 20
#: Ids up to which a list of the documents needed is broadcast, to keep other texts out of a shuffle; beyond, all are joined.
BROADCAST_IDS = 1_000_000


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for slices of a text column."""
    offsets, data = text_buffer(column)
    for i, j in slices(offsets):
        base = int(offsets[i])
        _, _, words, first = word_hashes(data[base : offsets[j]], offsets[i : j + 1] - base, lower=True)
        h = mix(words)
        whole = np.zeros(len(h), U)
        n = len(h) - SHINGLE + 1
        if n > 0:
            total = np.zeros(n, U)
            for k in range(SHINGLE):
                total = total * U(BASE) + h[k : k + n]
            whole[:n] = mix(total)
        out = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= SHINGLE:
                out.append(np.unique(whole[a : z - SHINGLE + 1]))
            elif z > a:
                total = U(0)
                with np.errstate(over="ignore"):
                    for w in h[a:z]:
                        total = total * U(BASE) + w
                out.append(mix(np.array([total + U(z - a)], U)))
            else:
                out.append(np.zeros(0, U))
        yield i, out


def most_differing(n: np.ndarray | int) -> np.ndarray | int:
    """D(n): the largest symmetric difference of a set of n with one at least as large that it links with."""
    return (n + n * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def levels(n: int) -> list[tuple[int, int]]:
    """(level, blocks) where a set of n meets others: its own as the smaller set, and that of the smallest it links with."""
    low = -(-n * PERCENT // 100)
    own = _level(n)
    return [(lv, _blocks(lv)) for lv in range(_level(low), own + 1)]


def _level(n: int) -> int:
    return 0 if n <= TINY else (n - 1).bit_length() - (TINY - 1).bit_length()


def _blocks(level: int) -> int:
    """More blocks than the level's largest D, by a third and eight, so that enough of them are filled; 0: one a shingle."""
    return 0 if level == 0 else int(most_differing(TINY << level)) * 13 // 10 + 8


def block_keys(shingles: np.ndarray, level: int, blocks: int) -> np.ndarray:
    """Keys of the filled blocks of a set."""
    if not blocks:
        return mix(shingles ^ U(0x5DEECE66D))
    block = ((shingles >> U(32)) * U(blocks)) >> U(32)  # rises with the hash, so blocks are runs
    new = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    word = np.bitwise_xor.reduceat(mix(shingles), new)
    return mix(word ^ mix(block[new] * U(64) + U(level)))


def parity(shingles: np.ndarray) -> np.ndarray:
    """One-bit parity sketch of at least 2 bits a shingle, a power of two; halves fold by XOR."""
    bits = 256
    while bits < 2 * len(shingles) and bits < 1 << 16:
        bits *= 2
    at = (mix(shingles ^ U(0xA5A5A5A5)) & U(bits - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


_SETS = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lighten()
    for b in batches:
        for i, sets in shingle_sets(b.column("text")):
            n = [len(s) for s in sets]
            h1 = np.array([int(s.sum()) if len(s) else 0 for s in sets], U)
            h2 = np.array([int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets], U)
            sketch = [parity(s).tobytes() if len(s) else b"" for s in sets]
            ids = b.column("doc_id").slice(i, len(sets))
            yield pa.record_batch([ids, pa.array(n, pa.int64()), mix(h1).view(np.int64), h2.view(np.int64), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])


def _planes(x: np.ndarray, n: int = 8) -> bytes:
    """Integers by byte plane: high planes are nearly constant, so the shuffle's compression removes them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:n]).tobytes()


def _from_planes(data: bytes, n: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return out.reshape(-1).view(U)


def _emit_keys(buckets: int):
    names = ["bucket", "keys", "docs"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        weak: list[int] = []
        held, seen = 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal keys, docs, held
            k, d = np.concatenate(keys), np.concatenate(docs)
            at = ((k >> U(48)) * U(buckets)) >> U(16)
            order = np.argsort(at, kind="stable")
            k, d, at = k[order], d[order], at[order]
            new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            cuts = list(zip(new.tolist(), [*new[1:].tolist(), len(k)], strict=True))
            out = pa.record_batch(
                [pa.array(at[new].astype(np.int32)), pa.array([_planes(k[a:z]) for a, z in cuts], pa.binary()), pa.array([_planes(d[a:z]) for a, z in cuts], pa.binary())],
                names=names,
            )
            keys, docs, held = [], [], 0
            return out

        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, sets in shingle_sets(b.column("text")):
                for doc, s in zip(ids[i:].tolist(), sets, strict=False):
                    if not len(s):
                        continue
                    same = hash((len(s), s[0], s[-1], s.sum(), np.bitwise_xor.reduce(s)))
                    if same in seen:  # a copy in this task: its class is known by the set's hash
                        continue
                    seen.add(same)
                    if len(seen) > 100_000:
                        seen.clear()
                    for k, (lv, blocks) in enumerate(reversed(levels(len(s)))):
                        got = block_keys(s, lv, blocks)
                        if k == 0 and len(got) <= most_differing(len(s)):
                            weak.append(doc)
                        keys.append(got)
                        docs.append(np.full(len(got), doc, np.int64))
                        held += len(got)
                if held > 1_000_000:
                    yield flush()
        if held:
            yield flush()
        if weak:
            yield pa.record_batch([pa.array([-1], pa.int32()), [b""], [_planes(np.array(weak, np.int64))]], names=names)

    return emit


_MET = "kind int, a binary, b binary"


def _meet(batches: Iterator[pa.RecordBatch], small: int = SMALL) -> Iterator[pa.RecordBatch]:
    """Candidates of each bucket: kind 0 pairs (a[i], b[i]); kind 1 a large group (members in a); kind 2 weak documents."""
    names = ["kind", "a", "b"]

    def bucket(keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        same = keys[1:] == keys[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        keys, docs = keys[met], docs[met]  # keys of one row meet nothing
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        # Rows that repeat a document send its keys again: a group counts its documents once.
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[once], docs[once]
        new = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
        size = np.diff(np.append(new, len(keys)))
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []
        for n in range(2, small + 1):  # all pairs of small groups, by size
            rows = docs[new[size == n][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            xs.append(rows[:, i].reshape(-1))
            ys.append(rows[:, j].reshape(-1))
        groups: dict[bytes, np.ndarray] = {}
        for a, n in zip(new[size > small].tolist(), size[size > small].tolist(), strict=True):
            members = docs[a : a + n]
            groups.setdefault(members.tobytes(), members)
            turn = mix(members.view(U) ^ mix(np.array([int(keys[a]) % CENTRES], U)))
            centre = members[int(turn.argmin())]
            xs.append(np.full(len(members), centre))
            ys.append(members)
        x, y = np.concatenate(xs), np.concatenate(ys)
        xs.clear()
        ys.clear()
        on = x != y
        x, y = x[on], y[on]
        if len(x):
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            del order
            once = np.ones(len(x), bool)
            once[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            yield pa.record_batch([pa.array([0], pa.int32()), [x[once].tobytes()], [y[once].tobytes()]], names=names)
        kept = list(groups.values())
        for k in range(0, len(kept), 256):
            part = kept[k : k + 256]
            yield pa.record_batch([pa.array([1] * len(part), pa.int32()), pa.array([_planes(g) for g in part], pa.binary()), pa.array([b""] * len(part), pa.binary())], names=names)

    lighten()
    at, keys, docs = None, [], []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != at and keys:
                yield from bucket(np.concatenate(keys), np.concatenate(docs))
                keys, docs = [], []
            at = r["bucket"]
            if at < 0:
                yield pa.record_batch([pa.array([2], pa.int32()), [r["docs"]], [b""]], names=names)
            else:
                keys.append(_from_planes(r["keys"]))
                docs.append(_from_planes(r["docs"]).view(np.int64))
    if keys:
        yield from bucket(np.concatenate(keys), np.concatenate(docs))


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lighten()
    for b in batches:
        for a, z in zip(b.column("a"), b.column("b"), strict=True):
            yield pa.record_batch([np.frombuffer(a.as_py(), np.int64), np.frombuffer(z.as_py(), np.int64)], names=["x", "y"])


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lighten()
    for b in batches:
        for data in b.column("a").to_pylist():
            docs = _from_planes(data).view(np.int64)
            # A group is named by its members.
            name = int(np.bitwise_xor.reduce(mix(docs.view(U)))) ^ (len(docs) << 20)
            gid = np.full(len(docs), np.array([name & 0xFFFFFFFFFFFFFFFF], U).view(np.int64)[0])
            yield pa.record_batch([gid, docs], names=["gid", "doc_id"])


def _linked(n: np.ndarray, m: int, common: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + m - common)


def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose parity sketches differ in no more bits than linked sets may differ in shingles."""
    lighten()
    for b in batches:
        most = (b.column("nx").to_numpy() + b.column("ny").to_numpy()) * (100 - PERCENT) // (100 + PERCENT)
        on = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column("sx").to_pylist(), b.column("sy").to_pylist(), strict=True)):
            words = min(len(x), len(y)) // 8
            far = np.bitwise_count(fold(np.frombuffer(x, U), words) ^ fold(np.frombuffer(y, U), words)).sum()
            on[i] = far <= most[i]
        yield b.select(["x", "y"]).filter(pa.array(on))


def _texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """docs (doc_id, text) joined with need (doc_id, ...), a written table of one row a document."""
    ids = need.select("doc_id")
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.select("doc_id", "text").join(need, "doc_id")


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lighten()
    for b in batches:
        for i, sets in shingle_sets(b.column("text")):
            yield pa.record_batch([b.column("doc_id").slice(i, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets link.  x's set travels to its partners' tasks, PARTNERS at a time."""
    parts = pairs.groupBy("x").agg(F.expr(f"int(ceil(count(*) / {PARTNERS}))").alias("parts"))
    cut = pairs.join(parts, "x").select("x", "y", F.expr("int(pmod(xxhash64(y), parts))").alias("cut"))
    own = parts.select("x", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cut"))
    need = cut.unionByName(own).groupBy("y").agg(F.collect_list(F.struct("x", "cut")).alias("at")).withColumnRenamed("y", "doc_id")
    need = saved(need, "pairs-needed")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in batches:
            ids, ats = b.column("doc_id").to_pylist(), b.column("at").to_pylist()
            for i, sets in shingle_sets(b.column("text")):
                rows = [(a["x"], a["cut"], d != a["x"], d, s.tobytes()) for d, at, s in zip(ids[i:], ats[i:], sets, strict=False) for a in at]
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
                yield pa.record_batch(cols, names=["x", "cut", "partner", "y", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        own, mine = None, None
        for b in batches:
            xs, ys = [], []
            for r in b.to_pylist():
                s = np.frombuffer(r["shingles"], U)
                if not r["partner"]:
                    own, mine = (r["x"], r["cut"]), s
                    continue
                if own != (r["x"], r["cut"]):
                    raise ValueError("a pair without its centre")
                at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                if _linked(len(s), len(mine), np.count_nonzero(mine[at] == s)):
                    xs.append(r["x"])
                    ys.append(r["y"])
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    texts = _texts_of(docs, need).mapInArrow(spread, "x long, cut int, partner boolean, y long, shingles binary")
    dealt = texts.repartition(shuffle_width(docs.sparkSession), "x", "cut").sortWithinPartitions("x", "cut", "partner")
    return dealt.mapInArrow(check, "x long, y long").distinct()


class _SlicePair:
    """The members of one slice pair; side 0: one slice, met with itself; 1 and 2: the two slices."""

    def __init__(self, table: pa.Table):
        self.ids, self.n, comp, self.side = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "component", "side"))
        sketches = [np.frombuffer(s, U) for s in table.column("sketch").to_pylist()]
        words = min(map(len, sketches))
        self.sketch = np.stack([fold(s, words) for s in sketches])
        labels, self.of = np.unique(comp, return_inverse=True)
        self.joined = np.arange(len(labels))  # component -> the one it is joined with so far
        # All but the largest component's members meet every other component.
        turns = self.side == 1 if self.side.any() else self.of != np.bincount(self.of).argmax()
        self.turns = np.flatnonzero(turns).tolist()

    def near(self, k: int) -> np.ndarray:
        """Members of other components whose parity sketch is near enough to member k's."""
        n, own = self.n, self.joined[self.of]
        small, large = np.minimum(n, n[k]), np.maximum(n, n[k])
        on = np.flatnonzero((self.side != 1) & (own != own[k]) & (100 * small >= PERCENT * large))
        far = np.bitwise_count(self.sketch[on] ^ self.sketch[k]).sum(axis=1)
        return on[far <= (n[on] + n[k]) * (100 - PERCENT) // (100 + PERCENT)]


def _with_near(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a slice pair that have a near enough one in another component: only their sets need to travel."""
    table = pa.Table.from_batches(list(batches))
    pair = _SlicePair(table)
    has = np.zeros(table.num_rows, bool)
    for k in pair.turns:
        near = pair.near(k)
        has[near] = True
        has[k] |= len(near) > 0
    yield from table.filter(pa.array(has)).combine_chunks().to_batches()


def _across(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of one slice pair, by whole sets: a spanning forest, so fewer than it has members."""
    table = pa.Table.from_batches(list(batches))
    pair, sets = _SlicePair(table), [np.frombuffer(s, U) for s in table.column("shingles").to_pylist()]
    ids, n, of, joined = pair.ids, pair.n, pair.of, pair.joined
    xs, ys = [], []
    for k in pair.turns:
        for j in pair.near(k).tolist():
            a, b = joined[of[k]], joined[of[j]]
            if a == b:
                continue
            at = np.minimum(np.searchsorted(sets[k], sets[j]), len(sets[k]) - 1)
            if _linked(n[j], n[k], np.count_nonzero(sets[k][at] == sets[j])):
                xs.append(ids[k])
                ys.append(ids[j])
                joined[joined == b] = a
    yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])


def _band(n):
    """Size band: sets that link lie in the same or in neighbouring bands."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(100 / PERCENT))).cast("int")


#: What names a slice pair: the group, then band and slice of one, and kind, band and slice of the other.
_PAIR = ["gid", "band", "slice", "out_b", "band_b", "slice_b"]


def slice_pairs(groups: DataFrame) -> DataFrame:
    """groups (gid, rep, n, component): members dealt to the pairs of slices to compare, with their side of it.

    A group's members outside its largest component meet each other and that component's, so slices are cut by kind
    (out: outside), size band and hash, to about SLICE members; a group of no more than that is one slice.
    """
    by = groups.groupBy("gid", "component").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    main = F.expr("max_by(component, struct(c, component))").alias("main")
    open_ = by.groupBy("gid").agg(main, F.sum("c").alias("total"), F.sum("size").alias("size"), F.count("*").alias("k")).where("k > 1").drop("k")
    whole = (F.col("total") <= SLICE) & (F.col("size") * 8 <= SLICE_BYTES)
    members = groups.join(open_, "gid").select("gid", "rep", "n", "component", (whole | (F.col("component") != F.col("main"))).alias("out"), F.when(whole, 0).otherwise(_band("n")).alias("band"))
    cells = members.groupBy("gid", "out", "band").agg(F.greatest(F.ceil(F.count("*") / SLICE), F.ceil(F.sum("n") * 8 / SLICE_BYTES)).cast("int").alias("parts"))
    members = saved(members.join(cells, ["gid", "out", "band"]).withColumn("slice", F.expr("int(pmod(xxhash64(rep), parts))")).drop("parts"), "slices")
    until = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    other = cells.select("gid", F.col("out").alias("out_b"), F.col("band").alias("band_b"), F.col("parts").alias("parts_b"))
    pairs = cells.where("out").join(other, "gid").where("abs(band - band_b) <= 1 and (not out_b or band <= band_b)")
    pairs = pairs.withColumn("slice", until("parts")).withColumn("slice_b", until("parts_b")).where("not out_b or band < band_b or slice <= slice_b").select(_PAIR)
    alone = F.col("out_b") & (F.col("band") == F.col("band_b")) & (F.col("slice") == F.col("slice_b"))
    one = members.where("out").drop("out").join(pairs, ["gid", "band", "slice"]).withColumn("side", F.when(alone, 0).otherwise(1))
    two = members.select("gid", "rep", "n", "component", *(F.col(c).alias(f"{c}_b") for c in ("out", "band", "slice")))
    two = two.join(pairs.where(~alone), ["gid", "out_b", "band_b", "slice_b"]).withColumn("side", F.lit(2))
    return one.unionByName(two)


def near_duplicates(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = saved(rows.mapInArrow(_sets, _SETS), "shingle-sets")
    # Classes of equal sets, each known by its smallest doc_id.
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    to_class = filled.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["n_shingles", "h1", "h2"])
    to_class = saved(to_class.select("doc_id", "rep", F.col("n_shingles").alias("n"), F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")), "shingle-classes")
    rep = to_class.select("doc_id", "rep", "n")

    total = filled.agg(F.sum("n_shingles")).first()[0] or 0
    width = shuffle_width(spark)
    buckets = min(1 << 15, max(width, int(0.6 * total / BUCKET_KEYS) + 1))
    packed = rows.where("doc_id is not null").mapInArrow(_emit_keys(buckets), "bucket int, keys binary, docs binary")
    met = saved(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(_meet, small=small), _MET), "candidates")

    def by_class(pairs: DataFrame) -> DataFrame:
        x, y = (rep.select(F.col("doc_id").alias(c), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}")) for c in "xy")
        both = pairs.join(x, "x").join(y, "y")
        close = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * PERCENT
        return both.where((F.col("rx") != F.col("ry")) & close).select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct()

    pairs = met.where("kind = 0").mapInArrow(_pair_rows, "x long, y long").distinct()
    weak = met.where("kind = 2").mapInArrow(lambda it: (pa.record_batch([_from_planes(d.as_py()).view(np.int64)], names=["x"]) for b in it for d in b.column("a")), "x long")
    weak = weak.distinct().join(rep.select(F.col("doc_id").alias("x"), "n"), "x").select("x", F.explode(F.sequence(_band("n") - 2, _band("n") + 2)).alias("band"))
    sized = to_class.where("doc_id = rep").select(F.col("rep").alias("y"), _band("n").alias("band"))
    pairs = pairs.unionByName(weak.join(sized, "band").where("x != y").select("x", "y"))
    sketches = to_class.where("doc_id = rep").select("rep", "n", "sketch")
    near = by_class(pairs)
    for c in "xy":
        near = near.join(sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    near = saved(near.mapInArrow(_near_enough, "x long, y long"), "pairs")
    links = saved(verify(rows, near), "shingle-links")
    labels = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "rep")

    groups = met.where("kind = 1").mapInArrow(_group_rows, "gid long, doc_id long").join(rep, "doc_id").select("gid", "rep", "n").distinct()
    groups = saved(groups.join(labels, "rep", "left").select("gid", "rep", "n", F.coalesce("component", "rep").alias("component")), "groups")
    asked = slice_pairs(groups).join(sketches.select("rep", "sketch"), "rep").select(*_PAIR, "rep", "n", "component", "side", "sketch")
    asked = saved(asked.groupBy(_PAIR).applyInArrow(_with_near, asked.schema), "slices-near")
    need = saved(asked.select(F.col("rep").alias("doc_id")).distinct(), "slices-needed")
    whole_sets = saved(_texts_of(rows, need).mapInArrow(_own_sets, "rep long, shingles binary").dropDuplicates(["rep"]), "slice-sets")
    more = saved(asked.join(whole_sets, "rep").groupBy(_PAIR).applyInArrow(_across, "x long, y long").distinct(), "links-across")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "rep")
    of = rep.join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return sets.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the document of smallest doc_id stays, once.

    Documents that link with nothing stay, and so do rows with a null doc_id.
    """
    found = near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.struct("doc_id").alias("kept")).distinct()
    whole = docs.select(as_struct(docs))
    known = whole.join(found, F.col("doc.doc_id") == F.col("kept.doc_id")).select("doc", "doc.doc_id", F.xxhash64("doc.text").alias("print"))
    # Rows that repeat a document are copies of it.
    known = known.dropDuplicates(["doc_id", "print"]).select("doc").unionByName(whole.where("doc.doc_id is null"))
    return known.select(*[F.col(f"doc.`{n}`") for n in docs.columns])


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
