"""Operator 11: SentencePiece BPE by a table of each prefix's last token.

The library merges the best-scoring pair of neighbouring symbols, leftmost
first, until no merge is left.  Parts of a text that no merge joins do not
influence each other's merges, so the encoding of a prefix is a prefix of
encodings: every prefix has one last token.  A table stores it: an automaton
over the vocabulary yields the tokens that end at each place, and a token t
that starts at place s is the last one exactly if the prefix up to s ends in
a token p such that the pair (p, t), merged on its own, stays (p, t).  The ids
are then recovered backwards from the text's end.

A pair is tested by running the merge histories of its two tokens against
each other: a merge across their border would happen as soon as its score
beats the next merge on both sides (equal scores: the leftmost wins).
Histories and pair tests are kept, as they depend on the vocabulary alone.

Texts are cut before each run of spaces, which no piece of the vocabulary
crosses (checked when the model is read); the table of a chunk is made once
for as long as a worker remembers it.  Characters outside the vocabulary
become byte tokens.  The model's normalizer must be the identity with a space
put before the text, as read from the file; other models are refused.

Defined results: null text is empty (begin and end id alone); texts are
encoded whole; repeated rows have equal results; strings of control tokens in
a text are ordinary text, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import CACHES, slices, text_buffer
from ._store import documents, saved

#: Chunks and pair tests that a worker keeps at most, and the longest chunk kept (characters); results do not depend on them.
CACHE_CHUNKS, CACHE_PAIRS, LONGEST = 400_000, 400_000, 64
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MARKS = ",.;:!?"
#: Above every rank: no merge is left.
_NEVER = float("inf")
#: What stands before a token, if no token does: the chunk's start, or a character outside the vocabulary.
_START, _OTHER = -2, -1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol buffer message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """The vocabulary of a SentencePiece model file and its pair tests."""

    def __init__(self, model: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        with open(model, "rb") as f:
            rules = dict(_fields(dict((n, v) for n, v in _fields(f.read()) if n == 3)[3]))
        # Normalizer fields: 2 character map, 3 space before the text, 4 extra spaces removed, 5 spaces escaped; the last three default to true.
        if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("the model's normalizer is not the identity with a space before the text")
        n = lib.vocab_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.text) if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.id = {p: i for i, p in enumerate(self.text) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece crosses the start of a run of spaces")
        #: Marks that no piece has right after a letter.
        self.marks = "".join(m for m in _MARKS if not any(a.isalpha() and b == m for p in self.id for a, b in pairwise(p)))
        #: Merge order of pieces: the better the score the smaller; pieces of equal score are equal.
        self.rank = {p: -lib.get_score(i) for p, i in self.id.items()}
        self.bytes = [bytes([int(p[1:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.bytes[self.unk] = " ⁇ ".encode()  # what the library shows for it
        self._history: dict[str, tuple[list, list, int]] = {}
        self._pair: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def history(self, piece: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]], int]:
        """Merges of a piece's characters on their own: (rank of the next merge, first symbol) and (rank, last symbol)
        before each merge and at the end, and how many symbols stay."""
        got = self._history.get(piece)
        if got is None:
            rank, parts = self.rank, list(piece)
            first, last = [], []
            while True:
                best, at = _NEVER, -1
                for k in range(len(parts) - 1):
                    r = rank.get(parts[k] + parts[k + 1], _NEVER)
                    if r < best:
                        best, at = r, k
                first.append((best, parts[0]))
                last.append((best, parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self._history[piece] = (first, last, len(parts))
        return got

    def stays(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side, merged from characters on, stay these two tokens."""
        rank, a, b = self.rank, self.history(left)[1], self.history(right)[0]
        i = j = 0
        while True:
            (ra, end), (rb, start) = a[i], b[j]
            across = rank.get(end + start, _NEVER)
            if across < ra and across <= rb and across < _NEVER:  # leftmost of equals: left side, border, right side
                return False
            if ra <= rb:
                if ra == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def follows(self, left: int, right: int) -> bool:
        """Whether token ``right`` can stand after ``left`` (_START, _OTHER or an id): both stay what they are.
        A piece that its own merges do not reach is never a token."""
        piece = self.text[right]
        return (len(piece) == 1 or self.history(piece)[2] == 1) and (left < 0 or self.stays(self.text[left], piece))

    def last_tokens(self, chunk: str) -> list[int]:
        """The last token of every prefix of a chunk; _OTHER where it is a character outside the vocabulary."""
        pair, n = self._pair, len(self.text)
        if len(pair) > CACHE_PAIRS:
            pair.clear()
        table = [_OTHER] * len(chunk)
        for end, (size, piece) in self.automaton.iter(chunk):
            if table[end] == _OTHER:
                s = end - size
                left = table[s] if s >= 0 else _START
                ok = pair.get(left * n + piece)
                if ok is None:
                    ok = pair[left * n + piece] = self.follows(left, piece)
                if ok:
                    table[end] = piece
        return table

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk, recovered backwards from its table of last tokens."""
        table, text, out = self.last_tokens(chunk), self.text, []
        at = len(chunk) - 1
        while at >= 0:
            i = table[at]
            if i == _OTHER:
                out.extend(self.byte[b] for b in reversed(chunk[at].encode()))
                at -= 1
            else:
                out.append(i)
                at -= len(text[i])
        out.reverse()
        return out


class Encoder:
    """Ids of texts, with the ids of chunks met before kept in flat arrays."""

    def __init__(self, model: str):
        self.pieces = Pieces(model)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.size = array("i"), array("q"), array("q")

    def trim(self) -> None:
        """Keep the oldest half: frequent chunks come early."""
        k = min(CACHE_CHUNKS // 2, bisect_right(self.start, 8 * CACHE_CHUNKS) - 1)
        self.number = {c: n for c, n in self.number.items() if n < k}
        del self.ids[self.start[k] :], self.start[k:], self.size[k:]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each with the spaces before it."""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")

    def _add(self, chunk: str, got: Iterable[int]) -> int:
        k = len(self.start)
        self.start.append(len(self.ids))
        self.ids.extend(got)
        self.size.append(len(self.ids) - self.start[k])
        if len(chunk) <= LONGEST:
            self.number[chunk] = k
        return k

    def _new(self, chunk: str) -> int:
        word = chunk.rstrip(self.pieces.marks)
        if len(word) == len(chunk) or not word[-1:].isalpha():
            return self._add(chunk, self.pieces.chunk_ids(chunk))
        got = array("i")  # no merge joins a letter and the mark after it: the two parts are encoded on their own
        for part in (word, chunk[len(word) :]):
            k = self.number.get(part)
            if k is None:
                k = self._add(part, self.pieces.chunk_ids(part))
            got += self.ids[self.start[k] : self.start[k] + self.size[k]]
        return self._add(chunk, got)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids with begin and end ids, ids per text)."""
        if len(self.start) > CACHE_CHUNKS or len(self.ids) > 16 * CACHE_CHUNKS:
            self.trim()
        if not self.start:  # numbers 0 and 1: the begin and the end id
            self.start, self.size, self.ids = array("q", [0, 1]), array("q", [1, 1]), array("i", [self.pieces.bos, self.pieces.eos])
        find, new = self.number.get, self._new
        numbers: list[int] = []
        counts = []
        for t in texts:
            before = len(numbers)
            numbers.append(0)
            if t:
                parts = self.chunks(t)
                found = list(map(find, parts))
                if None in found:
                    for k, c in enumerate(parts):
                        if found[k] is None:
                            got = find(c)
                            found[k] = new(c) if got is None else got
                numbers += found
            numbers.append(1)
            counts.append(len(numbers) - before)
        at = np.array(numbers, np.int64)
        size = np.array(self.size, np.int64)[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        take = np.repeat(np.array(self.start, np.int64)[at] - upto[:-1], size) + np.arange(upto[-1])
        ends = upto[np.concatenate(([0], np.cumsum(counts)))]
        return np.array(self.ids, np.int32)[take], np.diff(ends)


class Decoder:
    """Texts of ids: control ids are nothing, byte ids join to UTF-8, and the space before the text goes."""

    def __init__(self, model: str):
        pieces = Pieces(model)
        tokens = pieces.bytes
        self.size = np.fromiter(map(len, tokens), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        #: Pieces whose leading space is the one put before the text, if they come first.
        self.spaced = np.array([p.startswith(SPACE) for p in pieces.text])
        self.control = np.zeros(len(tokens), bool)
        self.control[[i for i, t in enumerate(tokens) if not t and i != pieces.unk]] = True

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        n = self.size[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        data = self.data[np.repeat(self.start[ids] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        bounds = np.concatenate(([0], np.cumsum(lens)))
        ends = upto[bounds].tolist()
        texts = []
        for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
            if a < z and data[a : a + 1] == b" ":
                own = ids[bounds[k] : bounds[k + 1]]
                head = own[~self.control[own]][0]
                a += self.spaced[head]
            texts.append(_utf8(data[a:z]))
        return texts


def _utf8(data: bytes) -> str:
    """Bytes as text, one replacement character for each byte that belongs to no character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join("�" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in data.decode("utf-8", "surrogateescape"))


_ENCODERS: dict[str, Encoder] = {}
_DECODERS: dict[str, Decoder] = {}
CACHES += (_ENCODERS, _DECODERS)


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids (with begin and end ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[model] = Encoder(model)
        for b in batches:
            offsets, _ = text_buffer(b.column("text"))
            for i, j in slices(offsets):
                ids, lens = _ENCODERS[model].encode(b.column("text").slice(i, j - i).fill_null("").to_pylist())
                upto = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(upto, pa.array(ids))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # encoding is over: its tables would only take room beside the texts
        if model not in _DECODERS:
            _DECODERS[model] = Decoder(model)
        for b in batches:
            ids = b.column("ids")
            texts = _DECODERS[model].decode(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()))
            yield pa.record_batch([b.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """Per row of rows (doc_id, ids): doc_id, ids, text."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, ids array<int>, text string")


def _digests(decoded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in decoded:
        ids = b.column("ids")
        lens = np.diff(ids.offsets.to_numpy())
        view, ends = memoryview(ids.flatten().to_numpy().astype("<u4")).cast("B"), np.cumsum(lens).tolist()
        digest = [hashlib.sha256(view[4 * a : 4 * z]).hexdigest() for a, z in zip([0, *ends], ends, strict=False)]
        back = [hashlib.sha256(t.encode()).hexdigest() for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), pa.array(lens, pa.int64()), digest, back], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, of the written ids and the texts they decode to."""
    decode = _decode(model)
    rows = saved(encode_ids(docs, model), "piece-ids")  # one Python worker decodes and digests
    return rows.mapInArrow(lambda it: _digests(decode(it)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
