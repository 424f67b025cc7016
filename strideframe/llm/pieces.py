"""SentencePiece ids of whole texts from a table of distinct chunks, and texts from ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .ragged import buffers
from .ragged import chunks as chunked

#: Text bytes that are cut at a time, a whole text at least.
BLOCK_BYTES = 1 << 22
#: Chunks that a Python worker remembers between batches, about 200 bytes each, and segments at a time.
REMEMBERED, SEGMENTED = 200_000, 10_000
#: Ids that are decoded at a time, a whole text at least.
DECODED_IDS = 1 << 20

MARK = "▁"


class Model:
    """A BPE model whose pieces cannot cross markers, and where its texts can be cut."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        kind = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(n)]
        pieces = self.library.id_to_piece(list(range(n)))
        plain = [p for i, p in enumerate(pieces) if not kind[i] and not self.library.is_byte(i)]
        probe = "ﬁ  Å　 x"
        if any(MARK in p.lstrip(MARK) for p in plain) or self.library.decode(self.library.encode(probe)) != probe or self.library.id_to_piece(self.library.encode("x")[0])[0] != MARK:
            raise ValueError("pieces must not cross markers; texts must get a marker in front and else stay as they are")
        joined = set("".join(p for p in plain if len(p) > 1))
        #: bytes of characters that join no others, so that each is a chunk of its own
        self.lone = np.array([b != 32 and chr(b) not in joined for b in range(128)] + [False] * 128)
        if not self.lone[10]:
            raise ValueError("a line break must not be part of a longer piece")
        self.odd = np.array([self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in range(n)])
        self.surface = pa.array([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.spaced = np.array([p[0] == MARK for p in pieces])

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Chunks of some texts, a marker being a space, and where each text's begin.

        A chunk starts at the first of a run of markers, and at and after a lone character.
        """
        marked = pc.replace_substring(texts, MARK, " ")
        raw, off = buffers(pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise("", marked, " ")))
        space, lone = raw == 32, self.lone[raw]
        first = lone | space
        first[1:] &= ~(space[1:] & space[:-1])
        first[1:] |= lone[:-1]
        first[off[:-1][off[:-1] < len(raw)]] = True
        start = np.flatnonzero(first)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
        return chunks.dictionary_encode(), np.searchsorted(start, off)

    def segment(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks: what the library gives behind a line break, which itself takes two ids."""
        return [ids[2:] for ids in self.library.encode(["\n" + c.decode() for c in chunks], num_threads=1)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. Those with bytes that are no text, or with ids that stand for none, by the library."""
        flat, off = ids.values.to_numpy(zero_copy_only=False)[ids.offsets[0].as_py() : ids.offsets[-1].as_py()], ids.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        known = (flat >= 0) & (flat < len(self.odd))
        if not known.all():
            raise ValueError("ids beyond the model's pieces")
        whole = self.surface.take(pa.array(flat))
        at = np.frombuffer(whole.buffers()[1], np.int64)[: len(flat) + 1]
        ends = at[off]
        start = ends[:-1].copy()
        some = off[1:] > off[:-1]
        start[some] += self.spaced[flat[off[:-1][some]]]
        odd = np.r_[0, np.cumsum(self.odd[flat])]
        data, out = memoryview(whole.buffers()[2] or b""), []
        for k, (a, b) in enumerate(zip(start.tolist(), ends[1:].tolist(), strict=True)):
            text = None
            if odd[off[k]] == odd[off[k + 1]]:
                try:
                    text = str(data[a:b], "utf-8")
                except UnicodeDecodeError:
                    pass
            out.append(self.library.decode(flat[off[k] : off[k + 1]].tolist()) if text is None else text)
        return pa.array(out, pa.string())


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    """One for each Python worker."""
    return Model(path)


class ChunkTable:
    """Ids of distinct chunks, each segmented once for a worker as long as it is remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.ids = model, {}

    def of(self, chunks: list[bytes]) -> pa.ListArray:
        """A list of ids for each of some distinct chunks."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new = [c for c in chunks if c not in self.ids]
        for i in range(0, len(new), SEGMENTED):
            part = new[i : i + SEGMENTED]
            self.ids.update((c, np.array(ids, np.int32).tobytes()) for c, ids in zip(part, self.model.segment(part), strict=True))
        found = [self.ids[c] for c in chunks]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of texts: those of their distinct chunks, taken in the order in which these stand."""
        chunks, off = self.model.cut(texts)
        each = self.of(chunks.dictionary.to_pylist()).take(chunks.indices)
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(each).to_numpy())))[off]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each.flatten())


@lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    """One for each Python worker, which serves many tasks."""
    return ChunkTable(_model(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of every whole text, without begin or end, as the model's library gives them.

    ``model``: path of a BPE model without normalisation whose pieces hold markers at their
    beginning only, the same on all executors; others are refused. Texts become places in a
    list of distinct chunks (marked words, and characters that join nothing); each worker has a
    table of chunks with their ids, and takes them by place. One narrow pass, nothing is
    shuffled. Null text counts as empty and has no ids. Repeated rows each get a row; texts of
    any length are whole. Columns other than doc_id (a long) and text are not looked at. An
    empty table gives none.
    """
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for i, j, _, _ in chunked(texts, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), _table(model).encode(texts.slice(i, j - i))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (doc_id and ids) with ``text``: what the model's library decodes. Null ids give a null text."""
    ship(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            n = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + DECODED_IDS, "right")))
                part = ids.slice(i, j - i)
                text = _model(model).decode(pa.array(part.to_pylist(), part.type) if part.null_count else part)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), part, pc.if_else(part.is_null(), pa.scalar(None, pa.string()), text)], names=["doc_id", "ids", "text"])
                i = j

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Number of ids, and digests of ids (decimal, joined by commas) and of texts."""

    def sha(c: Column) -> Column:
        return F.sha2(c, 256)

    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"))
