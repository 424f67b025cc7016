"""Training sequences packed along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ship, text_key
from .ragged import U, byte_letters, chunks, mix, words

LENGTH, END = 2048, 1
#: The curve runs through DIMENSIONS axes of 2**BITS cells.
DIMENSIONS, BITS = 4, 8
#: Text bytes of a range of the curve; each range starts a sequence of its own.
RANGE_BYTES = 24_000_000
#: Borders that a sample of keys places, and documents of the sample for each; between two
#: borders the key space is cut evenly. They decide how large ranges are, and nothing else.
BORDERS, BORDER_SAMPLE = 20_000, 1_000

#: Documents whose pieces a Python worker holds at once.
SLICE = 1_000

#: The pieces that byte-level vocabularies of this kind merge within (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer points (n, d) on the Hilbert curve of 2**bits cells an axis.

    Follows the curve's own definition level by level: at each level the quadrant is the Gray
    code rank of the point's leading bits, and the axes are reflected and exchanged for the
    level below.
    """
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for b in range(bits - 1, 0, -1):
        bit, rest = 1 << b, (1 << b) - 1
        for axis in range(d):
            set_ = (x[:, axis] & bit) != 0
            x[set_, 0] ^= rest
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, axis]) & rest)
            x[:, 0] ^= swap
            x[:, axis] ^= swap
    for axis in range(1, d):
        x[:, axis] ^= x[:, axis - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, d - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in range(d):
            key = (key << 1) | ((x[:, axis] >> b) & 1)
    return key


def curve_keys(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hilbert key of each text: its words hash to signs on each axis, the mean is the place.

    A sum of n signs has spread sqrt(n), by which it is scaled, so that texts of all lengths
    spread over the cells. A wordless text lies in the middle.
    """
    w = words(raw, off)
    count = np.diff(w.row)
    out = np.zeros((len(count), DIMENSIONS))
    for axis in range(DIMENSIONS):
        signs = ((w.hash >> U(7 + 11 * axis)) & U(1)).astype(np.int64) * 2 - 1
        sums = np.concatenate(([0], np.cumsum(signs)))
        out[:, axis] = (sums[w.row[1:]] - sums[w.row[:-1]]) / np.sqrt(np.maximum(count, 1))
    cells = np.clip((out / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells)


class Encoder:
    """Token ids as the library gives them.

    Texts of common characters go to the byte-pair core that works on ranks alone, which is
    three times as fast and gives the same ids; those with special strings, or characters
    whose class may differ between Unicode versions, go to the library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self._library = path, None
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        self.special = [t["content"] for t in held["added_tokens"]]
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in held["model"]["vocab"].items() if t not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):  # noqa: ANN201
        """Read only where a text needs it: two vocabularies are much for a Python worker."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __call__(self, text: str) -> bytes:
        """ids of the whole text, two bytes each."""
        if any(s in text for s in self.special) or not _COMMON.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return np.array(self.core.encode_ordinary(text), "<u2").tobytes()


#: Characters whose classes all Unicode versions share.
_COMMON = regex.compile("[\\x00-\u024f\u0400-\u045f\u2010-\u2027\u3041-\u3093\u4e00-\u9fa5]*+")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _full_key(keys: np.ndarray, ids: pa.Array, text_keys: np.ndarray) -> np.ndarray:
    """The curve key above a hash of the row, so that copies of one text still part into ranges."""
    tie = mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U) ^ mix(text_keys.view(U)))
    return (keys << 30) | (tie >> U(34)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key").to_numpy(zero_copy_only=False)
        for i, j, raw, off in chunks(batch.column("text")):
            yield batch.slice(i, j - i), _full_key(curve_keys(raw, off), ids[i:j], keys[i:j])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of documents, packed into sequences of ``length`` tokens along the curve.

    Documents are dealt to ranges of the curve by key, each range of about RANGE_BYTES of
    text; within a range they follow one another in key order and are cut wherever a sequence
    is full. So a range's last sequence alone is padded. Ids are made once, before the only
    shuffle, and travel as two bytes each.

    Repeated rows, ties of the curve, part by a hash of id and text. Very long texts are encoded
    and cut whole; one longer than a range makes a longer range. ``tokenizer``: path of a byte-level BPE file of fewer than 65,536 ids, the same on all
    executors. Null text is empty: its document is the end id alone. Repeated rows are packed
    each. Columns other than doc_id and text are not looked at. An empty table gives none.
    Returns doc_id, start, length, ids (two bytes each), ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id, offset.
    """
    ship(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, -(-size // RANGE_BYTES))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    wide = min(ranges, BORDERS)
    pieces_of = -(-ranges // wide)
    ranges = wide * pieces_of
    borders: list[int] = []
    if wide > 1:
        sample = rows.sample(min(1.0, max(20_000, BORDER_SAMPLE * wide) / n), seed=7).mapInArrow(keys, "key long")
        borders = sorted(set(sample.select(F.percentile_approx("key", [i / wide for i in range(1, wide)], 100_000)).first()[0] or []))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = _encoder(tokenizer), np.array(borders, np.int64)
        low, high = np.r_[0, at], np.r_[at, (1 << DIMENSIONS * BITS + 30)]
        for part, key in _rows(batches):
            wide = np.searchsorted(at, key, "right")
            place = np.minimum(((key - low[wide]) / np.maximum(high[wide] - low[wide], 1) * pieces_of).astype(np.int64), pieces_of - 1)
            ids = [encode(t) + end.to_bytes(2, "little") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array((wide * pieces_of + place).astype(np.int32)), pa.array(key), pa.array(ids, pa.binary())], names=["doc_id", "range", "key", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sequence, offset = None, 0, 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            out: dict[str, list] = {c: [] for c in _PIECES.names}
            for doc, part, ids in zip(batch.column("doc_id").to_pylist(), batch.column("range").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if part != now:
                    now, sequence, offset = part, part << 36, 0
                start, total = 0, len(ids) // 2
                while start < total:
                    take = min(length - offset, total - start)
                    own = ids[2 * start : 2 * (start + take)]
                    crc = zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes())
                    for c, v in zip(out, (doc, start, take, own, crc, total, sequence, offset), strict=True):
                        out[c].append(v)
                    start, offset = start + take, offset + take
                    if offset == length:
                        sequence, offset = sequence + 1, 0
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    made = rows.mapInArrow(encoded, "doc_id long, range int, key long, ids binary")
    placed = made.repartitionById(min(ranges, common.PARTITIONS), "range").sortWithinPartitions("range", "key", "doc_id")
    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def digest(pieces: DataFrame) -> DataFrame:
    """The rows of ``pack`` with the checksum of their ids alone; an empty table gives none."""
    return pieces.drop("ids")
