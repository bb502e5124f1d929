"""Operators 11 to 13 against their library or brute force, with the awkward cases in the tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from farelens.llm import piece_bpe, prefix_trie, vector_codes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def piece_texts(library):
    rng = random.Random(3)
    abc = "etaoin shrdlucmfwyp  ▁\n.,'é日😀ABC019çüß\t"
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    out = [None, "", " ", "  ", "   a", "a ", "\n", " \n x", "▁a", "▁▁ a", "<s>a</s> <unk> <0x41>", "日本語 😀👍🏽", " " * 100, "\x00a\x00", "ﬁ ½ �", "aaaaaaaaaaaaaaaa bbbb"]
    out += ["".join(rng.choice(abc) for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(800)]
    out += ["x" * 30_000, "word " * 300_000, "é日" * 5000]  # the second is longer than a slice
    return out


def test_sentencepiece(spark, library, piece_texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(piece_texts)]
    rows += [rows[20], rows[20], (None, piece_texts[21], None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(library.decode(ids).encode())))
    got = [tuple(r) for r in piece_bpe.round_trip(docs, MODEL).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert piece_bpe.round_trip(docs.limit(0), MODEL).collect() == []


def test_sentencepiece_caches_do_not_matter(library, piece_texts, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(piece_bpe, "CACHE_PAIRS", 20)
    enc, texts = piece_bpe.Encoder(MODEL), [t or "" for t in piece_texts[:900]]
    for k in range(0, len(texts), 100):
        ids, lens = enc.encode(texts[k : k + 100])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == library.encode(texts[k : k + 100], add_bos=True, add_eos=True)


def test_sentencepiece_decodes_any_ids(library):
    rng, dec = random.Random(5), piece_bpe.Decoder(MODEL)
    runs = [[rng.randrange(0, 32000) if rng.random() < 0.6 else rng.randrange(0, 262) for _ in range(rng.randrange(0, 8))] for _ in range(3000)]
    runs += [[], [1, 2], [0], [259, 259, 300]]
    flat = np.array([i for r in runs for i in r], np.int64)
    assert dec.decode(flat, np.array([len(r) for r in runs])) == [library.decode(r) for r in runs]


def _codes(rows):
    """(vec_id, code, error, label_error, codebooks digest) in plain Python."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = len(min((i, len(v)) for i, v, _ in kept if i is not None) and min(((i, v) for i, v, _ in kept if i is not None))[1])
    kept = [(i, [int(x * 4096 // 1) if abs(x) < 2**50 else int(x) * 4096 for x in v], lab) for i, v, lab in kept if len(v) == dim]
    w, first = dim // 8, {}
    for i, q, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, q), q)
    books = [[first[i][p * w : (p + 1) * w] for i in sorted(first)[:16]] for p in range(8)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            own = {}
            for _, q, _ in kept:
                own.setdefault(near(p, q[p * w : (p + 1) * w])[1], []).append(q[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    digest = _sha(",".join(str(x) for part in books for e in part for x in e).encode())
    out = []
    for i, q, lab in kept:
        found = [near(p, q[p * w : (p + 1) * w]) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab, digest))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return [(i, c, e, total[lab], d) for i, c, e, lab, d in out]


VECTORS = "vec_id long, embedding array<double>, label int, code string, salt int, error long"


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e4])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * scale).tolist(), (None, 1, 2)[i % 3]) for i in range(3, 120)]
    rows += [(i, [0.0] * 16, 1) for i in (1, 2)] + [(200 + i, rng.integers(-2, 3, 16).astype(float).tolist(), None) for i in range(40)]
    rows += [rows[0], rows[0], rows[5], (4, [0.5] * 16, 2), (None, [0.25] * 16, 2), (None, None, None)]
    rows += [(300, None, 1), (301, [None] + [0.0] * 15, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 1), (304, [1.0] * 8, 1), (305, [], 1)]
    table = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTORS)
    got = [tuple(r) for r in vector_codes.code_report(table).collect()]
    want = [(i, c, e if e < 2**63 else None, t, d) for i, c, e, t, d in _codes([r for r in rows if r[1] != [] and (r[1] is None or len(r[1]) != 8)])]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_vector_codes_small(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.code_report(empty).collect() == []
    nameless = spark.createDataFrame([(None, [1.0] * 8, 1, None, None, None)], VECTORS)
    assert vector_codes.code_report(nameless).collect() == []
    rows = [(i, [float(i)] * 8, None) for i in range(3)]  # fewer ids than entries
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS)
    assert sorted(map(tuple, vector_codes.code_report(table).collect())) == sorted(_codes(rows))
    codes, books = vector_codes.compress(table)
    back = {r.vec_id: r.embedding for r in vector_codes.decode(codes, books).collect()}
    assert all(abs(x - i) <= 1 / 4096 for i, v in back.items() for x in v)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.code_report(spark.createDataFrame([(1, [1.0] * 9, 1, None, None, None)], VECTORS))


def test_equal_average_search_skips_and_stays_exact():
    rng = np.random.default_rng(9)
    for kind in (np.int64, object):
        entries = rng.integers(-500, 500, (16, 8)).astype(kind)
        entries[7] = entries[3]
        x = np.concatenate((rng.integers(-500, 500, (400, 8)).astype(kind), entries))
        index, far, seen = vector_codes.PartSearch(entries).nearest(x)
        plain = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == plain.astype(float).argmin(axis=1).tolist()
        assert far.tolist() == plain.min(axis=1).tolist()
        assert seen < 0.9 * len(x) * 16


def test_integers_of_any_size():
    x = np.array([[1e300, -1e300, 0.5, -0.00001]])
    assert vector_codes.integers(x).tolist() == [[int(1e300) * 4096, -int(1e300) * 4096, 2048, -1]]
    limbs = list(vector_codes._limbs(-(1 << 200) + 5))
    assert sum(v << (32 * k) for k, v in limbs) == -(1 << 200) + 5 and all(-(1 << 63) <= v < 1 << 63 for _, v in limbs)


def _trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for v in turns.values():
        v.sort(key=lambda t: (t[0], t[1], _sha(f"{len(t[2])}:{t[2]}{t[3]}".encode())[:32]))
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(np.fmod(c, 20))
        paths[c] = tuple(t[2:] for t in turns.get(family, [])[:h] + own[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(WORDS.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), len(kids.get(p, [])), leaves[p], saved[p], _sha(ends.encode())))
    return out


CONVERSATIONS = "conv_id long, turn int, role string, text string, path string, family long, kind int"


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(2)
    said = ["", "hello there", "how are you", "fine\tthanks a lot", "é ü", None]
    rows = [(c, k, rng.choice(["user", "bot", None]) if c % 3 else "user", rng.choice(said)) for c in range(-45, 260) for k in range(rng.randrange(1, 7)) if c % 41]
    rows += [(c, k, "user", f"common {k}") for c in range(1000, 1300) for k in range(4)]  # copies, over many shards
    rows += [(c, k, "user", f"common {k % 2}") for c in (2000, 2001) for k in range(500)]  # long
    rows += [(3000, None, "a", "x"), (3000, None, "a", "y"), (3000, 1, "b", "z"), (3000, 1, "b", "z"), (3000, 1, "b", "z"), (3007, 2, None, "word " * 3000)]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), (-(2**63), 1, "user", "least"), (2**63 - 1, 1, "user", "most")]
    rows += rows[10:14]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [7, 64, prefix_trie.BLOCK_TURNS])
def test_prefix_trie(spark, conversations, block_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_PIECE", 16)
    table = spark.createDataFrame([(*r, "p", 1, 2) for r in conversations], CONVERSATIONS)
    frame = prefix_trie.prefix_trie(table, block_turns)
    assert frame.columns == prefix_trie.COLUMNS
    assert sorted(map(tuple, frame.collect()), key=lambda r: r[:2]) == sorted(_trie(conversations), key=lambda r: r[:2])


def test_prefix_trie_small(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.prefix_trie(spark.createDataFrame([(*r, "p", 1, 2) for r in rows], CONVERSATIONS)).collect() == []
    none = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 and c % 20)  # loses its turn, has no family head
    rows = [(none, 1, "user", "gone")]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "p", 1, 2) for r in rows], CONVERSATIONS)).collect()
    assert list(map(tuple, got)) == _trie(rows) and got[0].depth == 0


def test_sql_of_trie_and_codes(conversations):
    con = duckdb.connect()
    cols = list(zip(*[r for r in conversations if r[0] is None or abs(r[0]) < 2**62], strict=True))
    table = pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *map(pa.array, cols[2:])], names=["conv_id", "turn", "role", "text"])
    con.register("conversations", table)
    want = _trie(list(zip(*cols, strict=True)))
    assert sorted(con.sql(prefix_trie.ORACLE).fetchall(), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * 0.2).tolist(), i % 3 or None) for i in range(60)] + [(60, None, 1), (61, [None] * 16, 1)]
    con.register("embeddings", pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["vec_id", "embedding", "label"]))
    assert sorted(con.sql(vector_codes.ORACLE).fetchall()) == sorted(_codes(rows))


def test_word_and_its_marks_are_encoded_once_each(monkeypatch):
    asked = []
    real = piece_bpe.Pieces.chunk_ids
    monkeypatch.setattr(piece_bpe.Pieces, "chunk_ids", lambda self, chunk: asked.append(chunk) or real(self, chunk))
    monkeypatch.setattr(piece_bpe, "CACHE_CHUNKS", 20)
    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    enc = piece_bpe.Encoder(model)

    def check(texts):
        ids, lens = enc.encode(texts)
        bounds = np.concatenate(([0], np.cumsum(lens)))
        for t, a, z in zip(texts, bounds, bounds[1:], strict=False):
            assert ids[a:z].tolist() == lib.encode(t, add_bos=True, add_eos=True), t

    check(["haus haus, haus. haus?! haus,"])
    assert sorted(asked) == sorted(["▁haus", ",", ".", "?!"])
    check(["früh, a.b, . , ,x é. 漢字! ☃. 5, a5. 日。 ,,, é. ▁. ▁, x▁,", "x. " * 9, ", haus", "haus  ."])
    check([f"wort{i}q, wort{i}q." for i in range(60)])
    asked.clear()
    check(["haus, haus."])  # beyond the limit the oldest chunks stay known
    assert not asked
