"""Language of a text: the lowest cross-entropy under Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, looked_up, ship
from .ragged import U, chunks, mix

#: Documents of a language that are learnt from, about; their n-grams bound the model's size.
SAMPLE = 2000
#: Languages whose models are held at once, about; where there are more, documents meet them in rounds.
LANGUAGES = 500
#: Share of these documents that calibrate rejection and aren't trained on.
CALIBRATE = 0.2
#: Letters whose evidence the score counts at most, so that long texts aren't all certain.
EVIDENCE = 30
#: Share of a language's calibration documents that its rejection threshold lets through.
ACCEPT = 0.999
UNKNOWN = "und"
SPACE = 32
#: Of a trigram its last symbol, and its last two.
LOW, MID = (1 << 21) - 1, (1 << 42) - 1


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Each code point as its lower-case letter, or a space if it isn't a letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of each text, two spaces ahead of it, and where each starts."""
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    rows = lead[off]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    folded = _folded()[points]
    gap = folded == SPACE
    twice = np.zeros(len(gap), bool)
    twice[1:] = gap[1:] & gap[:-1]
    starts = rows[:-1][rows[:-1] < len(gap)]
    twice[starts] = gap[starts]
    kept = np.concatenate(([0], np.cumsum(~twice)))[rows]
    n = len(off) - 1
    out = np.full(kept[-1] + 2 * n, SPACE, np.uint32)
    out[np.arange(kept[-1]) + np.repeat(2 * np.arange(1, n + 1), np.diff(kept))] = folded[~twice]
    return out, kept + 2 * np.arange(n + 1)


def trigrams(seq: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three symbols ending at each one of a text, 21 bits each, and each text's offsets into them."""
    s = seq.astype(np.uint64)
    key = (s[:-2] << U(42)) | (s[1:-1] << U(21)) | s[2:] if len(s) > 2 else np.zeros(0, np.uint64)
    inside = np.ones(len(key) + 2, bool)
    inside[row[:-1]] = inside[row[:-1] + 1] = False
    return key[inside[2:]], row - 2 * np.arange(len(row))


@dataclass
class Table:
    """Logarithms of one language's n-grams, found by binary search on sorted hashes."""

    hash: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, value: np.ndarray) -> Table:
        h = mix(key)
        at = np.argsort(h)
        return cls(h[at], np.log(value[at]).astype(np.float32))

    def find(self, h: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        """Values of hashes, or those of ``other`` where there are none."""
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.value[at], other)


def _discount(n: np.ndarray) -> float:
    one, two = np.sum(n == 1), np.sum(n == 2)
    return float(one / (one + 2 * two)) if one and two else 0.5


class Language:
    """Interpolated Kneser-Ney over three characters: log probabilities of what one language has.

    What it lacks is computed from the shorter n-gram and the context's back-off weight, so
    tables hold its own n-grams alone. ``symbols`` is how many symbols all languages have.
    """

    def __init__(self, k3: np.ndarray, n3: np.ndarray, symbols: int) -> None:
        at = np.argsort(k3)
        k3, n3 = k3[at], n3[at].astype(float)
        k2, left = np.unique(k3 & U(MID), return_counts=True)  # contexts to the left of each pair
        k1, before = np.unique(k2 & U(LOW), return_counts=True)
        d3, d2, d1 = _discount(n3), _discount(left), _discount(before)
        size = before.sum()
        p_new = d1 * len(k1) / size / (symbols + 1)
        q1 = (before - d1) / size + p_new
        c2, of2 = np.unique(k2 >> U(21), return_inverse=True)
        total2 = np.bincount(of2, left)
        w2 = d2 * np.bincount(of2) / total2
        q2 = (left - d2) / total2[of2] + w2[of2] * q1[np.searchsorted(k1, k2 & U(LOW))]
        c3, of3 = np.unique(k3 >> U(21), return_inverse=True)
        total3 = np.bincount(of3, n3)
        w3 = d3 * np.bincount(of3) / total3
        q3 = (n3 - d3) / total3[of3] + w3[of3] * q2[np.searchsorted(k2, k3 & U(MID))]
        self.p3, self.p2, self.p1, self.b3, self.b2 = (Table.of(k, q) for k, q in ((k3, q3), (k2, q2), (k1, q1), (c3, w3), (c2, w2)))
        self.unseen = float(np.log(p_new))

    def logs(self, hashes: tuple[np.ndarray, ...]) -> np.ndarray:
        """Log probabilities of trigrams, given the hashes of ``parts``."""
        three, two, one, context3, context2 = hashes
        shorter = self.b2.find(context2, 0.0) + self.p1.find(one, self.unseen)
        return self.p3.find(three, self.b3.find(context3, 0.0) + self.p2.find(two, shorter))


def parts(key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of trigrams, of their last two symbols and last one, and of both contexts."""
    return tuple(mix(x) for x in (key, key & U(MID), key & U(LOW), key >> U(21), (key & U(MID)) >> U(21)))


class Model:
    """Several languages, with the limits of their calibration documents."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], symbols: int) -> None:
        self.langs = sorted(counts)
        self.own = [Language(*counts[x], symbols) for x in self.langs]
        self.limits: dict[str, float] = {}

    def entropy(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol of each text in each language, and the text's letters and spaces.

        Each distinct trigram of the texts is looked up once in each language.
        """
        key, row = trigrams(*symbols(raw, off))
        n = np.diff(row)
        out = np.zeros((len(n), len(self.langs)))
        some = n > 0
        if some.any():
            distinct, at = np.unique(key, return_inverse=True)
            hashes, starts = parts(distinct), row[:-1][some]
            for i, language in enumerate(self.own):
                out[some, i] = -np.add.reduceat(language.logs(hashes)[at], starts, dtype=np.float64) / n[some]
        return out, n


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 on division by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in batch.column("lang").unique().to_pylist():
            own = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
            for _, _, raw, off in chunks(own):
                key, n = np.unique(trigrams(*symbols(raw, off))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])


def learnt_from(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, lang, calibrates) of the labelled documents to learn from, materialised.

    Of each language about ``sample`` documents that aren't held out and have a letter, whole,
    drawn by a hash of id and text, one at least; rows equal in both count once. A share of
    them calibrates, never a language's only one.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = lambda salt: F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    labelled = labelled.select("doc_id", "text", "lang", draw("sample").alias("draw"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least"))
    shares = sizes.select("lang", "n", "least", F.greatest(F.col("least"), F.lit(float(sample)) / F.col("n")).alias("share"))
    chosen = looked_up(labelled, shares, "lang", "n").where("draw <= share").dropDuplicates(["doc_id", "text", "lang"])
    return cut(chosen.select("text", "lang", ((F.col("draw") > F.col("least")) & (draw("calibrate") < CALIBRATE)).alias("calibrates")))


def train(docs: DataFrame, sample: int = SAMPLE) -> Iterator[Model]:
    """Models of every language among the labelled documents that aren't held out, about LANGUAGES in each.

    N-grams of the documents drawn by ``learnt_from`` are counted on the executors; rejection
    thresholds come from those of them that aren't trained on. None if there is no labelled text.
    """
    chosen = learnt_from(docs, sample)
    grams = cut(chosen.where("NOT calibrates").mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    n_langs, symbols = grams.agg(F.count_distinct("lang"), F.count_distinct(F.col("key").bitwiseAND(F.lit(LOW)))).first()
    rounds = -(-n_langs // LANGUAGES)
    for k in range(rounds):
        here = F.pmod(F.xxhash64("lang"), F.lit(rounds)) == k
        table = grams.where(here).toArrow()
        if not len(table):
            continue
        name = table.column("lang").combine_chunks().dictionary_encode()
        of, langs = name.indices.to_numpy(), name.dictionary.to_pylist()
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of))[:-1]
        key, n = (np.split(table.column(c).combine_chunks().to_numpy()[order], ends) for c in ("key", "n"))
        model = Model({lang: (key[i].view(np.uint64), n[i]) for i, lang in enumerate(langs)}, symbols)
        model.limits = _limits(chosen.where(F.col("calibrates") & here), model)
        yield model


def _limits(documents: DataFrame, model: Model) -> dict[str, float]:
    """Of each language the cross-entropy that ACCEPT of its calibration documents stay below."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {lang: k for k, lang in enumerate(shared.value.langs)}
        for batch in batches:
            for i, j, raw, off in chunks(batch.column("text")):
                h, _ = shared.value.entropy(raw, off)
                names = batch.column("lang")[i:j].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(h[np.arange(j - i), [at[x] for x in names]])], names=["lang", "h"])

    found = documents.mapInArrow(own, "lang string, h double").groupBy("lang").agg(F.percentile_approx("h", ACCEPT, 10_000).alias("h")).collect()
    return {r["lang"]: r["h"] for r in found}


#: What a document knows after some languages: the best so far, its cross-entropy and limit, and
#: the sum of all likelihoods, the best one's being 1.
_STATE = "lang string, least double, limit double, total double"


def _compared(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (doc_id, text, held_out and state) after the languages of ``model``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names, limits = np.array(m.langs, object), np.array([m.limits.get(x, np.inf) for x in m.langs])
        for batch in batches:
            for i, j, raw, off in chunks(batch.column("text")):
                h, n = m.entropy(raw, off)
                best, letters = h.argmin(axis=1), np.minimum(n, EVIDENCE)
                here = h[np.arange(j - i), best]
                had = batch.slice(i, j - i)
                before = had.column("least").fill_null(np.inf).to_numpy(zero_copy_only=False)
                name = np.array(had.column("lang").to_pylist(), object)
                new = (here < before) | (here == before) & np.array([a is None or b < a for a, b in zip(name, names[best], strict=True)], bool)
                least = np.minimum(here, before)
                old = np.where(np.isinf(before), 0.0, had.column("total").to_numpy(zero_copy_only=False) * np.exp((least - np.where(np.isinf(before), least, before)) * letters))
                total = old + np.exp((least[:, None] - h) * letters[:, None]).sum(axis=1)
                limit = np.where(new, limits[best], had.column("limit").fill_null(np.inf).to_numpy(zero_copy_only=False))
                none = n == 0
                state = [pa.array(np.where(new, names[best], name), pa.string(), mask=none), pa.array(least, mask=none), pa.array(limit, mask=none), pa.array(total)]
                yield pa.RecordBatch.from_arrays([had.column(c) for c in ("doc_id", "text", "held_out")] + state, names=["doc_id", "text", "held_out", "lang", "least", "limit", "total"])

    return rows.mapInArrow(run, f"doc_id long, text string, held_out boolean, {_STATE}")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The language of every whole text, learnt from labelled documents that aren't held out.

    lang_pred is the language of least cross-entropy a symbol, ties by name; ``und`` where
    the text is null or has no letter, with score 0. score is that language's share of the
    likelihoods of at most EVIDENCE symbols. ``rejected``: the cross-entropy is above what
    ACCEPT of the language's calibration documents have, so that the text is likely none of
    them; a language without any rejects none. Without labelled text all are ``und``. A null
    lang isn't learnt from. Every language is: with more than LANGUAGES of them, documents go
    through one round for as many, and are stored in between with the best so far. Repeated
    rows get equal results, one each, and are learnt from once. Very long texts are read
    whole. doc_id is a long. Columns other than doc_id, text and lang are not looked at. An
    empty table gives none.
    """
    ship(docs)
    state = [F.lit(None).cast(t).alias(c) for c, t in (part.split() for part in _STATE.split(", "))]
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), *state)
    for k, model in enumerate(train(docs, sample)):
        rows = _compared(cut(rows) if k else rows, model)
    known = F.col("least").isNotNull()
    return rows.select(
        "doc_id", "held_out", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, 1 / F.col("total")).otherwise(F.lit(0.0)).alias("score"), F.col("least").alias("cross_entropy"), (~known | (F.col("least") > F.col("limit"))).alias("rejected")
    )
