"""Exact, cached use of a word-level tokenizers file over whole texts.

``word_bpe_49k.json`` drops white space before it merges, so a text's ids are
the ids of its white-space separated chunks in order.  Chunks repeat, so each
distinct chunk is looked up once a call and encoded by the tokenizers library
once per worker; the cache is bounded and never changes a result.
"""

from __future__ import annotations

import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ._batches import CACHES, give_back, lighten

#: Entries kept at most, and those kept when the rest is let go (those met in most calls).
CACHE_WORDS, CORE_WORDS = 400_000, 250_000
#: With more parts than this, only those of the words that stay are kept.
CACHE_PARTS = 700_000
#: Words for one call of the library, whose results hold several hundred bytes a word.
LIBRARY_WORDS = 1 << 12
#: Bytes of text for one call: the more, the fewer times a word is looked up.
CALL_BYTES = 4 << 20
#: A run of these is one pre-token after letters; the apostrophe is not among them, it opens contractions.
_MARKS = string.punctuation.replace("'", "")


class _Index:
    """Numbers words as they come.  They are one Arrow column: in a dict of Python strings a word takes some ten times as much."""

    def __init__(self):
        self.keep(pa.array([], pa.large_string()))

    def __len__(self) -> int:
        return len(self.column)

    def keep(self, words: pa.Array) -> None:
        """Number these words alone, in order."""
        self.column, self.known = words, len(words)

    def number(self, words: pa.Array) -> np.ndarray:
        """The numbers of ``words``, which are distinct."""
        words = words.cast(pa.large_string())
        at = np.asarray(pc.index_in(words, value_set=self.column).fill_null(-1)).astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self) + np.arange(len(new))
        if len(new):
            self.column = pa.concat_arrays([self.column, words.take(pa.array(new))])
        return at

    def take_fresh(self) -> list[str]:
        """The words numbered since the last call."""
        fresh = self.column.slice(self.known).to_numpy(zero_copy_only=False).tolist()
        self.known = len(self)
        return fresh


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    """x with zeros after it, if it has fewer than n values."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class _Rows:
    """Growing lists of small integers, one a row."""

    def __init__(self):
        self.upto, self.values, self.n = np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        used = int(self.upto[self.n])
        self.upto = _longer(self.upto, self.n + len(sizes) + 1)
        self.values = _longer(self.values, used + len(values))
        self.upto[self.n + 1 : self.n + len(sizes) + 1] = used + np.cumsum(sizes)
        self.values[used : used + len(values)] = values
        self.n += len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows ``at`` one after another, where each row begins and the last ends)."""
        start = self.upto[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.upto[at + 1] - start, out=upto[1:])
        start -= upto[:-1]
        where = np.repeat(start, np.diff(upto))
        where += np.arange(len(where))
        return self.values[where], upto

    def keep(self, sizes: np.ndarray, values: np.ndarray) -> None:
        """These rows alone."""
        self.n = 0
        self.add(sizes, values)


class WordEncoder:
    """ids of texts under a tokenizers JSON file whose pre-tokenizer drops white space.

    A chunk is one or two parts, letters and a run of marks, which the
    tokenizer's pattern always splits; ids are kept by part.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: Contents that the library finds in the raw text, before it folds case.
        self.raw = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        #: Their first characters in any case: a chunk without one of these needs no further look.
        self.leads = sorted({c for s in self.raw for c in (s[0], s[0].upper())})
        self.ends = self._word_ends()
        self.bare = self._bare()
        self._clear()

    def _word_ends(self) -> np.ndarray | None:
        """Which ids end a pre-token, if the model marks each one's last byte with a suffix; None: it does not."""
        suffix, vocab = getattr(self.tok.model, "end_of_word_suffix", None), self.tok.get_vocab()
        if not suffix or any(c not in vocab or c + suffix not in vocab for c in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def _bare(self) -> Tokenizer:
        """The tokenizer without its normalizer, if that and the added tokens leave lower-case ASCII letters between single spaces alone."""
        state = json.loads(self.tok.normalizer.__getstate__()) if self.tok.normalizer else {"type": "Sequence", "normalizers": []}
        steps = state["normalizers"] if state["type"] == "Sequence" else [state]
        spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if any(map(str.isalpha, self.raw)) or any(n != spaces and n["type"] not in ("NFC", "NFKC", "Lowercase") for n in steps):
            return self.tok
        bare = Tokenizer(self.tok.model)
        bare.pre_tokenizer = self.tok.pre_tokenizer
        return bare

    def _clear(self) -> None:
        self.words, self.word_parts = _Index(), _Rows()
        self.parts, self.part_ids = _Index(), _Rows()
        #: Calls that met a word.
        self.calls = np.zeros(1024, np.int32)

    def _forget(self) -> None:
        """Keep CORE_WORDS words, those met in most calls (of equals the oldest)."""
        kept = np.sort(np.argsort(-self.calls[: len(self.words)], kind="stable")[:CORE_WORDS])
        flat, upto = self.word_parts.take(kept)
        if len(self.parts) > CACHE_PARTS:
            used, flat = np.unique(flat, return_inverse=True)
            used = used.astype(np.int64)
            ids, upto_ids = self.part_ids.take(used)
            self.parts.keep(self.parts.column.take(pa.array(used)))
            self.part_ids.keep(np.diff(upto_ids), ids)
        self.words.keep(self.words.column.take(pa.array(kept)))
        self.word_parts.keep(np.diff(upto), flat)
        calls, self.calls = self.calls[kept], np.zeros_like(self.calls)
        self.calls[: len(calls)] = calls

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids a word, ids) by the library, in one call: the ids that end a word, or word_ids, tell the words apart."""
        if all(map(str.isalpha, words)):
            if self.ends is not None:
                joined = " ".join(words)
                tok = self.bare if joined.isascii() else self.tok
                (enc,) = tok.encode_batch_fast([joined], add_special_tokens=False)  # without offsets and word_ids
                ids = np.asarray(enc.ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(words):  # one pre-token a word
                    return np.diff(last, prepend=-1), ids
            enc = self.tok.encode(" ".join(words), add_special_tokens=False)
            of = np.asarray(enc.word_ids, np.int64)
            if len(of) and of[-1] + 1 == len(words):
                return np.bincount(of, minlength=len(words)), np.asarray(enc.ids, np.uint32)
        enc = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.asarray(enc.word_ids, np.int64), minlength=len(words)), np.asarray(enc.ids, np.uint32)

    def _learn(self) -> None:
        fresh = self.words.take_fresh()
        joined = " ".join(fresh)  # no chunk holds a space
        folded = joined.lower().split(" ") if joined.isascii() else [w.lower() if w.isascii() else w for w in fresh]
        special: list[int] = []
        if any(c in joined for c in self.leads):  # such a chunk is the library's as it stands
            special = [i for i, w in enumerate(fresh) if any(c in w for c in self.leads) and any(s in w.lower() for s in self.raw)]
        for i in special:
            folded[i] = fresh[i]
        bases = [w.rstrip(_MARKS) for w in folded]
        size = np.fromiter(map(len, bases), np.int64, len(bases))
        cut = (size < np.fromiter(map(len, folded), np.int64, len(folded))) & np.fromiter(map(str.isalpha, bases), bool, len(bases))
        cut[special] = False
        two = np.flatnonzero(cut).tolist()
        tails = [folded[i][len(bases[i]) :] for i in two]
        for i in two:
            folded[i] = bases[i]
        sizes = 1 + cut.astype(np.int64)
        coded = pa.array(folded + tails, pa.large_string()).dictionary_encode()
        at = self.parts.number(coded.dictionary)[np.asarray(coded.indices)]
        flat = np.zeros(int(sizes.sum()), np.uint32)
        first = np.cumsum(sizes) - sizes
        flat[first] = at[: len(folded)]
        flat[first[cut] + 1] = at[len(folded) :]
        self.word_parts.add(sizes, flat)
        new = self.parts.take_fresh()
        kind = np.where(np.fromiter(map(str.isalpha, new), bool, len(new)), np.fromiter(map(str.isascii, new), bool, len(new)), 2)
        size, ids = np.zeros(len(new), np.int64), []
        for k in range(3):  # letters, ASCII letters alone, the rest
            of_kind = np.flatnonzero(kind == k)
            for i in range(0, len(of_kind), LIBRARY_WORDS):
                at = of_kind[i : i + LIBRARY_WORDS]
                size[at], got = self._library([new[i] for i in at.tolist()])
                ids.append(got)
        order = np.argsort(np.repeat(kind, size), kind="stable")  # library order -> order of the parts
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.part_ids.add(size, np.concatenate(ids)[back] if ids else np.zeros(0, np.uint32))

    def encode(self, texts: list[str] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of the texts, each followed by the id ``end``."""
        if len(self.words) > CACHE_WORDS:
            self._forget()
        give_back()  # what the last call held is several times what stays
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(chunks.offsets).astype(np.int64)
        bounds -= bounds[0]
        coded = chunks.flatten().dictionary_encode()
        del chunks
        at = self.words.number(coded.dictionary)
        if len(self.words) > self.words.known:
            self._learn()
        self.calls = _longer(self.calls, len(self.words))
        self.calls[at] += 1
        at = at[np.asarray(coded.indices)]
        parts, upto_parts = self.word_parts.take(at)
        del at, coded
        flat, upto = self.part_ids.take(parts)
        lens = np.diff(upto[upto_parts[bounds]])
        return np.insert(flat, np.cumsum(lens), end), lens + 1


_SHARED: dict[str, WordEncoder] = {}
CACHES.append(_SHARED)


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and file, so that its cache serves all of the worker's tasks until another operator's come."""
    lighten(_SHARED)
    if path not in _SHARED:
        _SHARED[path] = WordEncoder(path)
    return _SHARED[path]
