"""Code length of documents under prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, ship, stored
from .ragged import CHUNK_BYTES, LOWER, U, buffers, words

#: Longest context in bytes.
ORDER = 5
#: Bytes that no UTF-8 text holds: before a text, and after it.
BEFORE, AFTER = 0xFE, 0xFF
#: Text bytes of a group of documents; a group is counted and scored in one task. Larger
#: groups share more of their grams, so that fewer rows are looked up.
GROUP_BYTES = 32_000_000


def _grams(raw: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Each symbol with the ``order`` bytes before it, as one number, the oldest byte highest.

    Every text is preceded by BEFORE bytes and followed by AFTER.
    """
    lone = _framed(raw, off, order)
    out = np.zeros(len(lone) - order, np.int64)
    for j in range(order + 1):
        out = (out << 8) | lone[j : len(lone) - order + j]
    return out[out & 0xFF != BEFORE]


def _framed(raw: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    n = len(off) - 1
    out = np.full(len(raw) + n * (order + 1), BEFORE, np.uint8)
    shift = np.repeat(np.arange(1, n + 1) * order + np.arange(n), np.diff(off))
    out[np.arange(len(raw)) + shift] = LOWER[raw]
    out[off[1:] + np.arange(1, n + 1) * (order + 1) - 1] = AFTER
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return keys, np.bincount(at, np.concatenate((a[1], b[1])), len(keys)).astype(np.int64)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    """Words' keys are negative, grams' are not."""
    return (hashes | U(1 << 63)).view(np.int64)


def _pressed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpressed(x: bytes, n: int, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys by the steps between them."""
    return _pressed(np.diff(keys.view(U), prepend=U(0)))


def _stepped(x: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpressed(x, n, U), dtype=U).view(np.int64)


_BLOCK = "grp int, doc_id array<long>, train array<boolean>, length array<long>, text binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, the documents of each group as one compressed row, for the way to its task."""
    for batch in batches:
        group = batch.column("grp").to_numpy()
        order = np.argsort(group, kind="stable")
        batch, group = batch.take(pa.array(order)), group[order]
        raw, off = buffers(batch.column("text"))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        ends = np.r_[first, len(group)].astype(np.int32)
        texts = [_pressed(raw[off[i] : off[j]]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (batch.column("doc_id"), batch.column("train"), pa.array(np.diff(off)))]
        yield pa.RecordBatch.from_arrays([pa.array(group[first]), *lists, pa.array(texts, pa.binary())], names=["grp", "doc_id", "train", "length", "text"])


def _texts(blocks: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, training flags, bytes and offsets of the documents of blocks, some at a time."""
    for k in range(len(blocks)):
        ids, train, length = (blocks.column(c)[k].values for c in ("doc_id", "train", "length"))
        off = np.r_[0, np.cumsum(length.to_numpy(zero_copy_only=False))].astype(np.int64)
        raw = _unpressed(blocks.column("text")[k].as_py(), int(off[-1]), np.uint8)
        i, n = 0, len(ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
            yield ids[i:j], train[i:j].to_numpy(zero_copy_only=False).astype(bool), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


_COUNTED = "grp int, bucket int, size long, keys binary, n binary"


def _count(order: int, buckets: int):
    """Of a group: counts of distinct words and grams in training texts, 0 if only others have them, by bucket."""

    def run(blocks: pa.Table) -> pa.Table:
        sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for _, train, raw, off in _texts(blocks):
            w = words(raw, off)
            known = np.repeat(train, np.diff(w.row))
            keys, at = np.unique(_word_keys(w.hash), return_inverse=True)
            sums = _merged(sums, (keys, np.bincount(at, known, len(keys)).astype(np.int64)))
            for own, times in ((train, 1), (~train, 0)):
                if own.any():
                    size = np.diff(off)[own]
                    keys, n = _distinct(_grams(raw[np.repeat(own, np.diff(off))], np.concatenate(([0], np.cumsum(size))), order))
                    sums = _merged(sums, (keys, n * times))
        keys, n = sums
        bucket = keys % buckets
        at = np.lexsort((keys.view(U), bucket))
        keys, n, bucket = keys[at], n[at], bucket[at]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        ends = [*zip(first, [*first[1:], len(bucket)], strict=True)]
        grp = blocks.column("grp")[0].as_py() if len(blocks) else 0
        return pa.table(
            {
                "grp": pa.array([grp] * len(ends), pa.int32()),
                "bucket": pa.array(bucket[first].astype(np.int32)),
                "size": pa.array([j - i for i, j in ends], pa.int64()),
                "keys": pa.array([_steps(keys[i:j]) for i, j in ends], pa.binary()),
                "n": pa.array([_pressed(n[i:j]) for i, j in ends], pa.binary()),
            }
        )

    return run


def _summed(counted: pa.Table) -> pa.Table:
    """Of a bucket: each key's count over all groups."""
    sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for size, keys, n in zip(*(counted.column(c).to_pylist() for c in ("size", "keys", "n")), strict=True):
        parts.append((_stepped(keys, size), _unpressed(n, size, np.int64)))
        if sum(len(x) for x, _ in parts) > 4_000_000:
            sums, parts = _merged(sums, tuple(map(np.concatenate, zip(*parts, strict=True)))), []
    if parts:
        sums = _merged(sums, tuple(map(np.concatenate, zip(*parts, strict=True))))
    return pa.table({"key": pa.array(sums[0]), "n": pa.array(sums[1])})


_FOUND = "grp int, word boolean, size long, keys binary, v binary"


def _find(counted: pa.Table, values: pa.Table) -> pa.Table:
    """Of a bucket: each group's keys with their values, words that no training text has aside.

    Counts of words keep all digits; bits of grams travel in single precision.
    """
    key = values.column("key").to_numpy() if len(values) else np.zeros(0, np.int64)
    at = np.argsort(key)
    key, value = key[at], (values.column("v").to_numpy()[at] if len(values) else np.zeros(0))
    out: dict[str, list] = {c: [] for c in ("grp", "word", "size", "keys", "v")}
    for grp, size, coded in zip(*(counted.column(c).to_pylist() for c in ("grp", "size", "keys")), strict=True):
        own = _stepped(coded, size)
        spot = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
        hit = key[spot] == own if len(key) else np.zeros(len(own), bool)
        for word in (False, True):
            some = hit & ((own < 0) == word)
            if some.any():
                cost = value[spot[some]]
                for c, v in zip(out, (grp, word, int(some.sum()), _steps(own[some]), _pressed(cost if word else cost.astype(np.float32))), strict=True):
                    out[c].append(v)
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _gathered(found: pa.Table, word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of a group, from all buckets."""
    parts = [(_stepped(k, n), _unpressed(v, n, np.float64 if word else np.float32)) for w, n, k, v in zip(*(found.column(c).to_pylist() for c in ("word", "size", "keys", "v")), strict=True) if w == word]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    keys, values = map(np.concatenate, zip(*parts, strict=True))
    at = np.argsort(keys)
    return keys[at], values[at]


def _masked(order: int) -> Column:
    """The gram of a lower order within a key: its symbol and so many bytes before it."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def gram_bits(grams: DataFrame, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """(key, bits) of each gram of (key, n), where n counts training texts.

    Every symbol counts in its contexts of all orders. Bits follow method C with full
    exclusion: an escape has as many chances as the context has symbols, and the shorter
    context then leaves out the symbols of the longer one. Contexts are tables, so that the
    model grows with the corpus; a positive ``share`` leaves out those of two bytes or more
    that have less of all symbols.
    """
    log = lambda c: F.log2(c.cast("double"))
    symbols = {order: grams.where("n > 0")}
    for k in reversed(range(order)):
        symbols[k] = cut(symbols[k + 1].groupBy(_masked(k).alias("key")).agg(F.sum("n").alias("n")))
    least = share * (symbols[0].agg(F.sum("n")).first()[0] or 0) if share else 0
    contexts = {}
    for k in range(order + 1):
        own, sums = symbols[k], [F.sum("n").alias("total"), F.count("*").alias("kinds")]
        if k:
            own = own.join(symbols[k - 1].select(F.col("key").alias("p_key"), F.col("n").alias("p_n")), _masked(k - 1) == F.col("p_key"))
            sums.append(F.sum("p_n").alias("taken"))
        own = own.groupBy(F.shiftright("key", 8).alias("key")).agg(*sums)
        if k:
            # what an escape leaves in the shorter context: symbols not seen here, and their mass
            above = contexts[k - 1].select(F.col("key").alias("p_key"), F.col("total").alias("p_total"), F.col("kinds").alias("p_kinds"))
            parent = _masked(k - 2) if k > 1 else F.lit(0).cast("long")
            own = own.join(above, parent == F.col("p_key")).select("key", "total", "kinds", (F.col("p_total") - F.col("taken")).alias("mass"), (F.col("p_kinds") - F.col("kinds")).alias("fresh"))
        else:
            own = own.select("key", "total", "kinds", F.lit(0).cast("long").alias("mass"), (256 - F.col("kinds")).alias("fresh"))
        contexts[k] = cut(own.where(F.col("total") >= least) if k > 1 else own)

    def met(rows: DataFrame, k: int) -> DataFrame:
        context = F.shiftright(_masked(k), 8)
        return rows.join(contexts[k].withColumnRenamed("key", "c_key"), context == F.col("c_key"), "left")

    whole = cut(met(grams, order))
    seen = (F.col("n") > 0) & F.col("kinds").isNotNull()
    done = whole.where(seen).select("key", (log(F.col("total") + F.col("kinds")) - log(F.col("n"))).alias("bits"))
    # the others go down: bits of escapes so far, and what the last context left (null before any)
    escape = F.when(F.col("kinds").isNotNull(), log(F.col("total") + F.col("kinds")) - log(F.col("kinds"))).otherwise(F.lit(0.0))
    left = whole.where(~seen).select("key", escape.alias("bits"), F.col("mass").alias("l_mass"), F.col("fresh").alias("l_fresh"), F.lit(False).alias("found"))
    for k in reversed(range(order)):
        own = symbols[k].select(F.col("key").alias("s_key"), "n")
        left = met(left, k).join(own, _masked(k) == F.col("s_key"), "left")
        known, entered = F.col("kinds").isNotNull(), F.col("l_fresh").isNotNull()
        chances = F.when(entered, F.col("l_mass") + F.col("l_fresh")).otherwise(F.col("total") + F.col("kinds"))
        out = F.when(entered, F.col("l_fresh")).otherwise(F.col("kinds"))
        hit = known & F.col("n").isNotNull()
        step = F.when(F.col("found") | ~known, F.lit(0.0)).when(hit, log(chances) - log(F.col("n"))).when(entered & (F.col("l_mass") == 0), F.lit(0.0)).otherwise(log(chances) - log(out))
        left = left.select("key", (F.col("bits") + step).alias("bits"), F.when(known, F.col("mass")).otherwise(F.col("l_mass")).alias("l_mass"), F.when(known, F.col("fresh")).otherwise(F.col("l_fresh")).alias("l_fresh"), (F.col("found") | hit).alias("found"))
    last = F.when(F.col("found"), F.lit(0.0)).otherwise(log(F.coalesce("l_fresh", F.lit(256))))
    return done.union(left.select("key", (F.col("bits") + last).alias("bits")))


def in_training(doc_id: Column) -> Column:
    """False for documents held out: crc32 of the id as text leaves 1 on division by 5; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def _prime(n: int) -> int:
    """The least prime from ``n`` on, so that remainders deal keys out evenly."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def score_documents(docs: DataFrame, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """log10 probability of every whole text under partial matching over bytes, and of its words.

    Documents are dealt by a hash of id and text into groups of about GROUP_BYTES, compressed
    on the way. Each group counts its distinct words and byte grams; their sorted keys travel
    in as many buckets, where counts are summed over the corpus. The words' counts and the
    grams' bits return by bucket to the groups that have them, so that a very common one is as
    many numbers as there are groups. Words are told apart by 63-bit hashes.

    Null text counts as empty: it has the end token alone. A table without training documents
    gives the uniform byte model and N = 0, where base_score falls back to -0 per token; an
    empty one gives none. Repeated rows each get a row, and count as often. Very long texts
    are read whole; one longer than a group makes a longer group. Columns other than doc_id
    and text are not looked at.
    """
    ship(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), in_training(F.col("doc_id")).alias("train"))
    size, trained = rows.agg(F.sum(F.octet_length("text")), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    groups = max(1, -(-(size or 0) // GROUP_BYTES))
    buckets = _prime(groups)
    dealt = lambda df, of, n: df.repartitionById(min(n, common.PARTITIONS), of)
    blocks = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).mapInArrow(_blocks, _BLOCK)
    counted = stored(dealt(blocks, "grp", groups).groupBy("grp").applyInArrow(_count(order, buckets), _COUNTED))
    sums = stored(dealt(counted.drop("grp"), "bucket", buckets).groupBy("bucket").applyInArrow(_summed, "key long, n long"))
    bits_of = gram_bits(sums.where("key >= 0"), order, share)
    vocabulary = sums.where("key < 0 AND n > 0")
    kinds, tokens = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    V, N = kinds + (trained > 0), tokens + trained
    values = vocabulary.select("key", F.col("n").cast("double").alias("v")).union(bits_of.select("key", "bits")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    of_bucket = lambda df: dealt(df, "bucket", buckets).groupBy("bucket")
    found = of_bucket(counted.drop("n")).cogroup(of_bucket(values)).applyInArrow(_find, _FOUND)

    def score(texts: pa.Table, looked: pa.Table) -> pa.Table:
        (key, c), (gram, cost) = (_gathered(looked, word) for word in (True, False))
        low = np.log10(N + 0.5 * (V + 1)) if N else 0.0
        end = np.log10(trained + 0.5) - low if N else 0.0
        ids, held, n_tokens, n_known, base, bits = ([] for _ in range(6))
        for doc_ids, train, raw, off in _texts(texts):
            w = words(raw, off)
            own = _word_keys(w.hash)
            spot = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
            hit = (key[spot] == own) if len(key) else np.zeros(len(own), bool)
            count = np.where(hit, c[spot], 0) if len(key) else np.zeros(len(own))
            sums = np.concatenate(([0.0], np.cumsum(np.log10(count + 0.5) - low))) if N else np.zeros(len(own) + 1)
            hits = np.concatenate(([0], np.cumsum(hit)))
            ids.append(doc_ids)
            held.append(~train)
            n_tokens.append(np.diff(w.row) + 1)
            n_known.append(hits[w.row[1:]] - hits[w.row[:-1]] + (trained > 0))
            base.append(sums[w.row[1:]] - sums[w.row[:-1]] + end)
            spent = np.concatenate(([0.0], np.cumsum(cost[np.searchsorted(gram, _grams(raw, off, order))], dtype=np.float64)))
            at = off + np.arange(len(off))  # a symbol for each byte, and one for each end
            bits.append(spent[at[1:]] - spent[at[:-1]])
        flat = lambda x, dtype: np.concatenate(x).astype(dtype) if x else np.zeros(0, dtype)
        doc_id = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        return pa.table(
            {
                "doc_id": doc_id,
                "held_out": pa.array(flat(held, bool)),
                "n_tokens": pa.array(flat(n_tokens, np.int64)),
                "n_known": pa.array(flat(n_known, np.int64)),
                "train_tokens": pa.array(np.full(len(doc_id), N, np.int64)),
                "base_score": pa.array(flat(base, np.float64)),
                "score": pa.array(-flat(bits, np.float64) * np.log10(2.0)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    own = lambda df: dealt(df, "grp", groups).groupBy("grp")
    return own(blocks).cogroup(own(found)).applyInArrow(score, schema)
