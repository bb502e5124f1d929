"""Each operator against a brute-force version, on small tables with the awkward cases in them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from farelens.llm import ann, bpe, language, ngram_join, packing, secrets, substring_dedup, suffix_dedup, token_files, vector_dedup
from farelens.llm._graph import components
from farelens.llm._store import new_path
from farelens.llm._words import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs string, gram long, blob string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def _prose(rng, n):
    vocab = ["the", "Of", "anth", "èré", "ñas", "ingly,", "tion.", "wh", "日本", "x1", "(a)"] + [f"w{i}" for i in range(300)]
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage, base = _prose(rng, 120), _prose(rng, 150)
    out = [None, "", " ", "\n\t ", "1234 !!", "a", "one two", "One  TWO", "x" * 3000, "ab " * 700, _prose(rng, 6000)]
    out += [_prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    out += [f"{_prose(rng, 60)} {passage}\n{_prose(rng, 40)}" for _ in range(6)]
    for _ in range(14):  # near copies
        words = base.split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edited"
        out.append(" ".join(words))
    out += [base, base, base.upper(), passage, passage]
    out += [f"x password = 'hunter2{i}' AKIA{'Q' * (10 + i * 3)} {'0a' * (10 + i)} é Token:abcdef é" for i in range(5)]
    out += ["<|endoftext|>a <|endoftext|> b", "foo  bar   baz \n\n qux ", "½ ² Ⅷ İ ſ K a\x1cb", "😀 it's 'S we'LL"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("de", "en", None)[i % 3], None, None, "r", 1, "b") for i, t in enumerate(texts)]
    rows += [rows[40], rows[40], (None, texts[45], "en", "s", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def _key(row):
    return tuple((x is not None, x) for x in row)


def _same(frame, expected):
    assert sorted(map(tuple, frame.collect()), key=_key) == sorted(expected, key=_key)


def _covered(units, length):
    seen = {}
    for u in units:
        for p in range(len(u) - length + 1):
            seen[u[p : p + length]] = seen.get(u[p : p + length], 0) + 1
    for u in units:
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - length + 1):
            if seen[u[p : p + length]] > 1:
                gone[p : p + length] = True
        yield gone


@pytest.mark.parametrize("part", [4000, 2])
def test_suffix_dedup(docs, pairs, no_docs, monkeypatch, part):
    monkeypatch.setattr("farelens.llm._anchors.PART_SEGMENTS", part)
    units, out = [t.encode() for _, t in pairs], []
    for (i, _), u, gone in zip(pairs, units, _covered(units, 400), strict=True):
        kept = np.frombuffer(u, np.uint8)[~gone].tobytes()
        out.append((i, len(u), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sum(r[2] for r in out) > 5000
    _same(suffix_dedup.remove_repeats(docs), out)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    data = np.tile(rng.integers(0, 3, 900).astype(np.uint8), 3)
    at = np.arange(len(data) - 400)
    label, raw = suffix_dedup.equal_suffixes(data, at, 400), data.tobytes()
    windows = [raw[p : p + 400] for p in at]
    for p in at:
        same = [q for q in (p - 900, p + 900) if 0 <= q < len(at)]
        assert (label[p] >= 0) == (windows.count(windows[p]) > 1)
        assert all(label[p] == label[q] for q in same)


@pytest.mark.parametrize("part", [4000, 2])
def test_substring_dedup(docs, pairs, no_docs, monkeypatch, part):
    monkeypatch.setattr("farelens.llm._anchors.PART_SEGMENTS", part)
    units, out = [tuple(WORDS.findall(t)) for _, t in pairs], []
    for (i, _), u, gone in zip(pairs, units, _covered(units, 35), strict=True):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        out.append((i, len(u), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(r[2] for r in out) > 1000
    _same(substring_dedup.remove_repeats(docs), out)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_dedup_outputs(docs, pairs):
    """The kept text and the removed spans are rows of their own."""
    units, out = [tuple(WORDS.findall(t)) for _, t in pairs], []
    for (i, _), u, gone in zip(pairs, units, _covered(units, 35), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).tolist()
        out.append((i, " ".join(w for w, g in zip(u, gone, strict=True) if not g), str(list(zip(edge[::2], edge[1::2], strict=True)))))
    rows = substring_dedup.strip_repeats(docs).collect()
    assert sorted(((r.doc_id, r.kept_text, str([(s.start, s.stop) for s in r.removed])) for r in rows), key=_key) == sorted(out, key=_key)


def test_language(spark, no_docs):
    rng = random.Random(3)
    sound = {"de": "sch ung ein lich".split(), "fr": "eau oi tre ment".split()}
    rows = [(i, " ".join("".join(rng.choices(sound[g], k=3)) for _ in range(30)), g) for i, g in enumerate(["de", "fr"] * 60)]
    docs = spark.createDataFrame(rows + [(500, None, "de"), (501, "12 !", None), (502, "x", None)], "doc_id long, text string, lang string")
    model = language.train(docs.where(~language.held_out("doc_id")))
    got = {r.doc_id: r for r in language.predict(docs.withColumn("score", F.lit("clash")), *model).collect()}
    assert all(got[i].lang_pred == g and 0.9 < got[i].score <= 1 for i, _, g in rows)
    assert [got[i].lang_pred for i in (500, 501)] == ["und", "und"] and got[502].lang_pred in sound
    assert language.train(no_docs)[0] == []
    assert {r.lang_pred for r in language.predict(docs, *language.train(no_docs)).collect()} == {"und"}


def _ids(t, end):
    tok = Tokenizer.from_file(WORD_BPE)
    return np.array(tok.encode(t, add_special_tokens=False).ids + [end], "<u4")


def test_token_files(spark, docs, pairs, no_docs):
    path, start, out = new_path(spark, "t"), 0, []
    token_files.write_tokens(docs, path, WORD_BPE, 2)
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        ids = _ids(t, 2)
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    _same(token_files.read_tokens(spark, path), out)
    path = new_path(spark, "t")
    token_files.write_tokens(no_docs, path, WORD_BPE, 2)
    assert token_files.read_tokens(spark, path).count() == 0


def test_encoder_special_tokens_by_case():
    """A special token counts only as the file spells it; other spellings are plain text."""
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|>b, x<|endoftext|>, Hello <|STARTOFTEXT|>!! <|endoftext|>", "<|ENDOFTEXT|>"]
    flat, lens = WordEncoder(WORD_BPE).encode(texts, 2)
    assert flat.tolist() == np.concatenate([_ids(t, 2) for t in texts]).tolist() and lens.tolist() == [len(_ids(t, 2)) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
def test_patched_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(5, 300, n)).astype("u4")
    doc_ids, lens, back = token_files.read_chunk(token_files.write_chunk(np.array([3, 9]), np.array([0, n]), ids))
    assert doc_ids.tolist() == [3, 9] and lens.tolist() == [0, n] and (back == ids).all()


def test_packing(docs, pairs, no_docs):
    rows = packing.pack(docs, WORD_BPE, 1).collect()
    expected = sorted((i if i is not None else -1, zlib.crc32(_ids(t, 1).tobytes()), len(_ids(t, 1))) for i, t in pairs)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(n for _, _, n in expected)
    single = {i: t for i, t in pairs if i is not None and i != 40}
    for i, t in single.items():
        ids, at = _ids(t, 1), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(no_docs, WORD_BPE, 1).count() == 0


@pytest.mark.parametrize("hist", [{5: 10}, {256: 3}, {140: 1000}, {w: 1 + w * 37 % 50 for w in range(1, 257)}])
def test_packing_plan(hist):
    plan, room = packing.Plan(hist), {}
    for w, n in hist.items():
        for rank in range(n):
            for _, length, seq, _ in plan.place(w, rank, w * 8):
                room[seq] = room.get(seq, 0) + length
    total = sum(w * n for w, n in hist.items()) * 8
    assert max(room.values()) <= 2048 and sum(room.values()) == total and len(room) <= total / 2048 + 2


def test_secrets(spark, docs, pairs, no_docs):
    rules = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        (re.compile("[0-9a-f]+"), 0, 24),
    ]
    out = []
    for i, t in pairs:
        found = sorted((m.start(), k, m.end()) for k, (rx, g, n) in enumerate(rules) for m in rx.finditer(t) if len(m[g]) >= n)
        spans = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in found)
        out.append((i, *[sum(k == x for _, k, _ in found) for x in range(3)], hashlib.sha256(spans.encode()).hexdigest(), spans))
    ledger = new_path(spark, "ledger")
    _same(secrets.scan(docs, ledger).drop("blob"), out)
    before = spark.read.parquet(ledger).count()
    _same(secrets.scan(docs, ledger).drop("blob"), out)  # nothing new to scan
    assert spark.read.parquet(ledger).count() == before == len({t for _, t in pairs})
    secrets.scan(docs, ledger, "next").count()
    assert spark.read.parquet(ledger).count() == 2 * before
    assert secrets.scan(no_docs, new_path(spark, "ledger")).count() == 0
    masked = {r.doc_id: r for r in secrets.mask(docs, ledger).collect()}
    assert masked.keys() == {i for i, _ in pairs}
    assert all("hunter2" not in (r.text or "") for r in masked.values())


def test_bpe(docs, pairs, no_docs):
    tok, out = Tokenizer.from_file(BYTE_BPE), []
    for i, t in pairs:
        ids = tok.encode(t, add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    _same(bpe.encode_documents(docs, BYTE_BPE), out)
    assert bpe.encode_documents(no_docs, BYTE_BPE).count() == 0


def test_bpe_outputs(docs, pairs):
    """The ids and the texts they decode to are rows of their own."""
    tok = Tokenizer.from_file(BYTE_BPE)
    ids = {(i, t): tok.encode(t, add_special_tokens=False).ids for i, t in pairs}
    rows = bpe.encode_ids(docs, BYTE_BPE)
    _same(rows.selectExpr("doc_id", "concat_ws(',', ids)"), [(i, ",".join(map(str, ids[i, t]))) for i, t in pairs])
    back = bpe.decode_ids(rows, BYTE_BPE).select("doc_id", "text")
    _same(back, [(i, tok.decode(ids[i, t], skip_special_tokens=False)) for i, t in pairs])


def test_frequent_chunks_of_a_large_corpus(spark):
    """The lexicon stays full where more chunks than it holds are very frequent."""
    growing = [(f"g{k} " * int(5000 * 1.2**k),) for k in range(12)]
    assert bpe.frequent_chunks(spark.createDataFrame(growing, "text string"), 5) == sorted(f"g{k}" for k in range(7, 12))
    equal = spark.createDataFrame([(" ".join(f"e{k}" for k in range(100)),)] * 4200, "text string")
    assert 25 <= len(bpe.frequent_chunks(equal, 50)) <= 50
    assert len(bpe.frequent_chunks(equal, 100)) == 100


def test_lexicon_is_minimal_and_numbered(tmp_path):
    words = sorted({b"tap", b"taps", b"top", b"tops", b"s", b"ps"})
    sizes, ids = np.ones(len(words), np.int64), np.arange(len(words))
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words, sizes, ids))
    lexicon = bpe.Lexicon(str(path))
    assert lexicon.numbers(words).tolist() == list(range(len(words)))
    assert lexicon.numbers([b"t", b"", b"taps!", b"z"]).tolist() == [-1] * 4
    assert len(lexicon.finals) == 6  # root, t, p, ta = to, tap = top, and one end


def _cosine(spark, texts=None):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    x = np.concatenate([rng.standard_normal((150, 16)), *(c + rng.standard_normal((25, 16)) * 0.2 for c in centres)])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(400 + k, rows[3][1]) for k in range(45)]  # exact copies
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, []]
    return rows, [(600 + 20 * k, v) for k, v in enumerate(bad)]


VECTORS = "vec_id long, embedding array<float>, n long, links long"


def test_vector_dedup(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 32)
    rows, bad = _cosine(spark)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(near, label, 10**9).min(axis=1))
        if (low == label).all():
            break
        label = low
    out = [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)]
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in rows + bad], VECTORS)
    whole = out + [(i, 0, i, True) for i, _ in bad]
    _same(vector_dedup.near_duplicates(frame), whole)
    _same(vector_dedup.near_duplicates(frame.unionByName(frame)), whole + whole)  # a repeated row is no other vector
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_nearest(spark):
    rows, bad = _cosine(spark)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in rows + bad], VECTORS)
    for r in ann.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hit += len({int(v) for v in ids[np.lexsort((ids, -score))[:20]]} & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        assert np.allclose([s for _, _, s in found], [score[ids == v][0] for _, v, _ in found], rtol=1e-12)
    assert hit >= 0.9 * 20 * len(got)
    few = ann.nearest(frame.where("vec_id < 5"))
    assert [r.vec_id for r in few.orderBy("rank").collect()].__len__() == 4
    assert ann.nearest(frame.limit(0)).count() == 0
    # Rows that repeat change nothing; an id with another vector besides is still one candidate and one query.
    twice = ann.nearest(frame.unionByName(frame)).orderBy("query_id", "rank").collect()
    assert {q: [(r["rank"], r.vec_id) for r in twice if r.query_id == q] for q in got} == {q: [f[:2] for f in found] for q, found in got.items()}
    other = frame.withColumn("embedding", F.transform("embedding", lambda v: -v))
    both = ann.nearest(frame.unionByName(other)).collect()
    assert all(len({r.vec_id for r in both if r.query_id == q}) == 20 for q in got) and len(both) == 20 * len(got)


def test_nearest_probes_all_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    asked = codes[:40] ^ rng.integers(0, 2, (40, 4), dtype=np.uint16)
    apart = np.bitwise_count(asked[:, None, :] ^ codes[None, :, :]).sum(axis=2, dtype=int)
    for radius in (0, 1, 5, 20, 31, 64):
        assert (ann.Block(codes).within(asked, radius) == (apart <= radius)).all()


def test_nearest_best_keeps_ties_and_ids_once():
    ids = np.array([7, 3, 3, 9, 1] * 40)
    x = np.tile([[1.0, 0], [1, 0], [0.5, 0], [0.5, 0], [0.1, 0]], (40, 1))
    found, score = ann._best(ids, x, np.arange(200), np.array([1.0, 0]), 3, 1e-9)
    assert found.tolist() == [3, 7, 9] and score.tolist() == [1, 1, 0.5]


@pytest.mark.parametrize("small", [8, 2])
def test_ngram_join(spark, docs, no_docs, small):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for r in docs.collect():
        w = WORDS.findall((r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    out = [(i, len(sets[i]), label.get(i)) for i in [r.doc_id for r in docs.where("doc_id is not null").collect()]]
    assert len(links) > 50
    _same(ngram_join.near_duplicates(docs, small).where("doc_id is not null"), out)
    assert [r.component_id for r in ngram_join.near_duplicates(docs).where("doc_id is null").collect()] == [None, None]
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i in ids if label[i] == i) and kept.count(None) == 2


def test_ngram_join_repeated_rows():
    """A key's group is as large as its documents are many, however often their rows repeat."""
    docs = np.repeat(np.arange(10, 16), 2)
    batch = {"bucket": [0], "keys": [ngram_join._planes(np.full(len(docs), 77, np.uint64))], "docs": [ngram_join._planes(docs)]}
    met = [r for b in ngram_join._meet(iter([pa.record_batch(batch)])) for r in b.to_pylist()]
    pairs = {p for r in met for p in zip(np.frombuffer(r["a"], np.int64).tolist(), np.frombuffer(r["b"], np.int64).tolist(), strict=True)}
    assert [r["kind"] for r in met] == [0] and pairs == {(a, b) for a in range(10, 16) for b in range(a + 1, 16)}


@pytest.mark.parametrize("size", [6, 1000])
def test_ngram_join_slices(spark, monkeypatch, size):
    """An open group is compared in slices; what they emit are links, and join whatever links across its components join."""
    monkeypatch.setattr(ngram_join, "SLICE", size)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, np.uint64)
    sets, comp = {}, {}
    for i in range(90):
        own = rng.integers(0, 2**63, int(rng.integers(0, 14)) if i % 3 else 60, np.uint64)
        sets[i] = np.unique(np.concatenate((base[: rng.integers(30, 61)], own)))
        comp[i] = 0 if i % 4 == 0 else i
    rows = [(g, i, len(s), comp[i]) for g, upto in ((7, 90), (8, 5)) for i, s in sets.items() if i < upto] + [(9, i, len(sets[i]), 0) for i in range(0, 90, 4)]
    dealt = ngram_join.slice_pairs(spark.createDataFrame(rows, "gid long, rep long, n long, component long"))
    tasks = {}
    for r in dealt.collect():
        tasks.setdefault(tuple(r[c] for c in ngram_join._PAIR), []).append(r.asDict() | {"sketch": ngram_join.parity(sets[r.rep]).tobytes(), "shingles": sets[r.rep].tobytes()})
    assert {k[0] for k in tasks} == {7, 8} and (len(tasks) == 2 if size > 90 else max(map(len, tasks.values())) < 40)
    found = []
    for key, members in tasks.items():
        batch = pa.Table.from_pylist(members).combine_chunks().to_batches()
        got = [(x, y) for b in ngram_join._across(key, iter(batch)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        assert len(got) < len(members)
        found += [(min(p), max(p)) for p in got if key[0] == 7]
    common = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and 100 * common(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - common(a, b))}
    assert len(links) > 100 and set(found) <= links

    def parts(edges):
        label = dict(comp)
        for _ in sets:
            for a, b in edges:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
        return label

    assert parts(found) == parts(links)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {n: n for e in links for n in e}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {n: c for n, c in label.items() if n in got} and {n for e in links if e[0] != e[1] for n in e} == got.keys()


def test_plain_words_are_encoded_without_offsets():
    import public_tokenizers

    from farelens.llm._words import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Haus haus, HAUS. früh é क़ ǅ ﬁ 漢字 don't <|endoftext|> a<|EndOfText|>, b.c ... !x 5a\tb c  d\n", "", " ", "ÄÖ, äö."]
    for ends in (True, False):
        enc, slow = WordEncoder(path), []
        if not ends:
            enc.ends = None
        lib = enc.tok

        class Counting:
            def __getattr__(self, name):
                if name == "encode":
                    return lambda x, **k: slow.append(x) or lib.encode(x, **k)
                return getattr(lib, name)

        enc.tok = Counting()
        for _ in range(2):
            ids, lens = enc.encode(texts, 7)
            bounds = np.concatenate(([0], np.cumsum(lens)))
            for t, a, z in zip(texts, bounds, bounds[1:], strict=False):
                assert ids[a:z].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 7], t
        enc.encode(["nur worte hier"], 7)
        assert ("nur worte hier" in slow) == (not ends)


def test_letters_and_marks_after_them_are_known_parts():
    lib = WordEncoder(WORD_BPE).tok
    enc, slow = WordEncoder(WORD_BPE), []

    class Counting:
        def __getattr__(self, name):
            if name == "encode":
                return lambda x, **k: slow.extend(x) or lib.encode(x, **k)
            return getattr(lib, name)

    enc.tok = Counting()
    texts = ["Haus$$$ haus%%% it's an'% a_b x_ é*** <|endoftext|># a<|b, c-- d<|EndOfText|>$ q1$$ \\ [] ab'#", "haus*** [x] 's$ don't% naïve&"]
    ids, lens = enc.encode(texts, 7)
    want = [[*lib.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert ids.tolist() == sum(want, []) and lens.tolist() == [len(w) for w in want]
    assert "$$$" in slow and not {"haus$$$", "haus%%%", "haus***", "x_", "é***"} & set(slow)  # the marks alone, once each


def test_full_cache_keeps_the_words_met_most(monkeypatch):
    from farelens.llm import _words

    monkeypatch.setattr(_words, "LIBRARY_WORDS", 3, raising=False)
    monkeypatch.setattr(_words, "CACHE_WORDS", 40)
    monkeypatch.setattr(_words, "CORE_WORDS", 20)
    lib = WordEncoder(WORD_BPE).tok
    for most_parts in (10_000, 30):
        monkeypatch.setattr(_words, "CACHE_PARTS", most_parts, raising=False)
        rng, enc = random.Random(3), WordEncoder(WORD_BPE)
        learned, take = [], enc.words.take_fresh
        enc.words.take_fresh = lambda learned=learned, take=take: learned.extend(x := take()) or x
        enc.encode([" ".join(f"{chr(97 + k)}once," for k in range(25))], 7)
        often = ["Anreth,", "èré.", "ndstnt***", "<|endoftext|>", "x1"]
        for k in range(30):
            texts = [" ".join([*often, *(f"{''.join(rng.choices('abcdé', k=5))}{m}" for m in ("", ",", "$$", "'s", "9"))]), "", "x"]
            ids, lens = enc.encode(texts, 7)
            want = [[*lib.encode(t, add_special_tokens=False).ids, 7] for t in texts]
            assert ids.tolist() == sum(want, []) and lens.tolist() == [len(w) for w in want], k
        assert len(enc.words) <= 50 and [learned.count(w) for w in often] == [1] * 5


def test_cached_words_take_few_bytes():
    """Two workers' encoders stand beside an executor's heap: what one remembers must be small."""
    import gc
    import tracemalloc

    import pyarrow as pa

    n, rng = 60_000, random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghij", k=9)) for _ in range(n)})
    texts, enc = [" ".join(f"{w}," for w in words[k::50]) for k in range(50)], WordEncoder(WORD_BPE)
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    enc.encode(texts, 7)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(enc.words) == len(words) and held < 200 * len(words), held / len(words)
