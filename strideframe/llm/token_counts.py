"""Token counts by merging many pre-tokens at once, in rank order, on ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .ragged import SPACES, buffers, byte_letters

#: Pre-tokens that a Python worker remembers between batches, about 170 bytes each.
REMEMBERED = 1_000_000
#: Symbols that are merged at a time.
SYMBOLS = 1 << 18

_RARE = regex.compile("[^\\x00-\u024f]")


class Merges:
    """A byte-level BPE vocabulary with word ends, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.n = len(vocab)
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        # of a pair merged twice the later rank holds, as in a map that is filled in order
        key, at = np.unique(key[::-1], return_index=True)
        self.rank = (len(pairs) - 1 - at).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 20
        self._table(key)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _table(self, key: np.ndarray) -> None:
        """Open addressing: each key lies at its slot or one of the next ``reach`` ones."""
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.bits) + 64, np.iinfo(np.int32).max, np.int32)
        left, self.reach = np.arange(len(key)), 0
        slot = self._slot(key)
        while len(left):
            at = slot[left] + self.reach
            free = self.keys[at] < 0
            _, one = np.unique(at, return_index=True)
            put = one[free[one]]
            self.keys[at[put]], self.ranks[at[put]] = key[left[put]], self.rank[left[put]]
            left = np.delete(left, put)
            self.reach += 1

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the largest int where it isn't one."""
        key = a.astype(np.int64) * self.n + b
        slot = self._slot(key)
        out = np.full(len(key), np.iinfo(np.int32).max, np.int32)
        for j in range(self.reach):
            hit = self.keys[slot + j] == key
            out[hit] = self.ranks[slot[hit] + j]
        return out

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token after all merges.

        All sequences move in step: each round finds every sequence's lowest-ranked pair and
        merges all its places there at once (left to right where they overlap), until no
        sequence has a pair. Finished sequences leave the arrays.
        """
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.zeros(len(tokens), np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        end = np.cumsum(size)
        sym = self.first[raw]
        sym[end[size > 0] - 1] = self.last[raw[end[size > 0] - 1]]
        seq = np.repeat(np.arange(len(tokens)), size)
        none = np.iinfo(np.int32).max
        rank = np.full(len(sym), none, np.int32)
        join = seq[:-1] == seq[1:]
        rank[:-1][join] = self.rank_of(sym[:-1][join], sym[1:][join])
        while len(sym):
            row = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(rank, row)
            length = np.diff(np.append(row, len(seq)))
            done = low == none
            if done.any():
                out[seq[row[done]]] = length[done]
                stay = np.repeat(~done, length)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            here = rank == np.repeat(low, length)
            spot = np.flatnonzero(here)
            near = np.concatenate(([False], np.diff(spot) == 1))
            if near.any():  # a run of overlapping places: every second one, from the left
                head = np.maximum.accumulate(np.where(near, 0, np.arange(len(spot))))
                spot = spot[(np.arange(len(spot)) - head) % 2 == 0]
            sym[spot] = self.made[rank[spot]]
            gone = np.zeros(len(sym), bool)
            gone[spot + 1] = True
            stay = ~gone
            fresh = np.zeros(len(sym), bool)
            fresh[spot] = True
            fresh[np.maximum(spot - 1, 0)] = True
            sym, seq, rank, fresh = sym[stay], seq[stay], rank[stay], fresh[stay]
            # ranks change at a merged symbol and at the one before it
            at = np.flatnonzero(fresh | np.concatenate((fresh[1:], [False])))
            rank[at] = none
            at = at[at < len(sym) - 1]
            at = at[seq[at] == seq[at + 1]]
            rank[at] = self.rank_of(sym[at], sym[at + 1])
        return out


class Counter:
    """Tokens of pieces of text without white space, remembered between batches."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.merges, library = Merges(path), Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.known: dict[str, int] = {}
        self.specials = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None

    def learn(self, pieces: list[str]) -> None:
        tokens: dict[str, int] = {}
        split = []
        for p in pieces:
            q = p.lower()
            if p >= "\u0250" or _RARE.search(p):
                found = self._by_library(self.normalizer.normalize_str(p))
            elif q.isalpha():
                found = (q,)
            elif q[:-1].isalpha() and not q[-1].isspace():
                found = (q[:-1], q[-1])
            else:
                found = self.merges.split.findall(q if p.isascii() else self.normalizer.normalize_str(p))
            split.append([tokens.setdefault(t, len(tokens)) for t in found])
        names = [t.encode("utf-8", "surrogateescape") for t in tokens]
        counts, size = np.zeros(len(names), np.int64), np.cumsum([0, *map(len, names)])
        i = 0
        while i < len(names):
            j = max(i + 1, int(np.searchsorted(size, size[i] + SYMBOLS, "right")) - 1)
            counts[i:j] = self.merges.count(names[i:j])
            i = j
        counts = counts.tolist()
        for p, found in zip(pieces, split, strict=True):
            self.known[p] = counts[found[0]] if len(found) == 1 else sum(counts[t] for t in found)

    def _by_library(self, piece: str) -> list[str]:
        """Other scripts go by the library's own character classes, whose Unicode version may differ."""
        return [bytes(map(self.byte.__getitem__, t)).decode("utf-8", "surrogateescape") for t, _ in self.splitter.pre_tokenize_str(piece)]

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: special strings count one and part the text around them."""
        extra = np.zeros(len(texts), np.int64)
        special = pc.match_substring_regex(texts, "|".join(map(regex.escape, self.merges.special))) if self.specials else None
        if special is not None and pc.any(special).as_py():
            whole = texts.to_pylist()
            for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
                whole[k], extra[k] = self.specials.subn(" ", whole[k])
            texts = pa.array(whole, pa.string())
        raw, off = buffers(texts)
        inside = ~SPACES[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = off[off < len(raw)]
        first[cuts] = inside[cuts]
        start = np.flatnonzero(first)
        solid = np.concatenate(([0], np.cumsum(inside)))  # place of a byte once spaces are gone
        bounds = np.append(solid[start], solid[-1])
        pieces = pc.dictionary_encode(pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(raw[inside])))
        names = pieces.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([p for p in names if p not in self.known])
        each = np.fromiter((self.known[p] for p in names), np.int64, len(names))
        sums = np.concatenate(([0], np.cumsum(each[pieces.indices.to_numpy(zero_copy_only=False)])))
        off = np.searchsorted(start, off)
        return sums[off[1:]] - sums[off[:-1]] + extra


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, as the library of the vocabulary gives them.

    ``tokenizer``: path of a byte-level BPE file with word ends, the same on all executors.
    One narrow pass; nothing is shuffled. A batch's distinct pieces are merged together. Null
    and empty texts have none; texts of any length are whole. Repeated rows each get a row. Columns other than doc_id and
    text are not looked at. An empty table gives none.
    """

    ship(docs)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counter.of(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
