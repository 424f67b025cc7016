"""Spelling variants: words of a corpus within one edit of each other, and the form each follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Words that one key may have before it is split into two longer ones.
GROUP_WORDS = 4096
#: Pairs of a word and a prefix that are worked on at a time.
PAIRS = 1 << 20


def runs(docs: DataFrame, pattern: str = RUN) -> DataFrame:
    """doc_id and ``run`` of every match of ``pattern`` in whole texts, A-Z in lower case; a null text has none."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("run"))


def misspelt(rows: DataFrame, every: int = 199) -> Column:
    """``run`` without one code point where ``every`` divides the CRC-32 of ``doc_id:run``; a null doc_id keeps its runs."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return F.when(h % every == 0, less).otherwise(F.col("run"))


def vocabulary(words: DataFrame, length: int = 6, least: int = 5) -> DataFrame:
    """``word`` and ``n``: distinct words of at least ``length`` code points and ``least`` occurrences."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Key of a word: what it has outside its free middle, for pairs whose shorter word has ``m`` code points."""
    outside = F.concat_ws("|", "m", "p", F.substring(F.col("word"), F.lit(1), F.col("p")), F.expr("right(word, s)"))
    return rows.withColumn("key", outside)


def _halves(m: Column, p: Column, s: Column) -> Column:
    """Of two words alike in ``p`` code points before and ``s`` behind, the edit lies behind or in the free part's first half."""
    half = F.floor((m - p - s) / 2).cast("int")
    return F.array(F.struct((p + half).alias("p"), s.alias("s")), F.struct(p.alias("p"), (m - p - half).alias("s")))


def candidates(vocab: DataFrame, length: int, most: int = GROUP_WORDS) -> DataFrame:
    """Each word under the keys where those within one edit of it stand too: (key, m, p, s, word, n).

    Two such words, the shorter of ``m`` code points, are alike before or behind its middle. A
    key with more than ``most`` words is split the same way, as often as needed and until one
    code point is free, of which there are only so many; no word is dropped. Exactly one key
    holds both words of a pair and has their first difference in its free part.
    """
    size = F.length("word")
    each = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= length)
    parts = F.explode(_halves(F.col("m"), F.lit(0), F.lit(0))).alias("h")
    rows = _keyed(each.select("word", "n", "m", parts).select("word", "n", "m", "h.*"))
    while True:
        counts = rows.where("m - p - s > 1").groupBy("key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
        large = small(counts.select("key"))
        if large.isEmpty():
            return rows
        again = rows.join(large, "key", "left_semi").select("word", "n", "m", F.explode(_halves(F.col("m"), F.col("p"), F.col("s"))).alias("h")).select("word", "n", "m", "h.*")
        rows = stored(rows.join(large, "key", "left_anti").unionByName(_keyed(again)))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word's begin."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    return points, np.concatenate(([0], np.cumsum(size)))


def near_pairs(group: np.ndarray, free: np.ndarray, start: np.ndarray, points: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking word, other word) of one group whose free parts are exactly one edit apart.

    Words are sorted by group and free part, ``free`` code points from ``start`` on. Words that
    share a prefix are neighbours, so each prefix is a range that ends where the common prefix
    of neighbours is shorter. An asking word's row of the edit matrix, a band of three cells
    about the diagonal, is worked out once for a range and reused by all words in it; a range
    whose row exceeds one edit is left out with all its words. All asking words go down one
    code point at a time together.
    """
    n = len(group)
    deepest = int(free.max(initial=0)) + 1
    lcp = np.zeros(n + 1, np.int64)  # with the word before; -1 across groups
    alike = np.concatenate(([False], group[1:] == group[:-1]))
    lcp[:-1][~alike] = -1
    lcp[n] = -1
    live = np.flatnonzero(alike)
    for d in range(deepest):
        live = live[(free[live] > d) & (free[live - 1] > d)]
        live = live[points[start[live] + d] == points[start[live - 1] + d]]
        lcp[live] = d + 1
    first = np.flatnonzero(lcp[:-1] < 0)
    out_a, out_b = [], []
    top = np.repeat(first, np.diff(np.append(first, n)))
    heads = [np.flatnonzero(lcp[:-1] < d) for d in range(deepest + 2)]  # first words of the ranges that share d code points
    ends = [np.append(h[1:], n) for h in heads]
    who = np.flatnonzero(asks)
    step = max(1, PAIRS // 64)
    for i in range(0, len(who), step):
        q = who[i : i + step]
        lo = top[q]
        hi = ends[0][np.searchsorted(heads[0], lo)]
        # cells d-1, d, d+1 of row d; two stands for two and more
        band = np.stack((np.full(len(q), 2), np.zeros(len(q), np.int64), np.ones(len(q), np.int64)), 1).astype(np.int8)
        for d in range(deepest + 1):
            # words that end here are the first of their range
            done = free[lo] == d
            gap = free[q] - d
            cell = np.where(np.abs(gap) <= 1, band[np.arange(len(q)), np.clip(gap + 1, 0, 2)], 2)
            hit = done & (cell == 1)
            # equal free parts can't be: words are distinct
            out_a.append(q[hit])
            out_b.append(lo[hit])
            a, b = np.searchsorted(heads[d + 1], lo), np.searchsorted(heads[d + 1], hi)
            a += done  # the range of the word that ends here has no next code point
            many = np.maximum(b - a, 0)
            rep = np.repeat(np.arange(len(q)), many)
            if not len(rep):
                break
            node = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + a[rep]
            lo, hi = heads[d + 1][node], ends[d + 1][node]
            q, band = q[rep], band[rep]
            letter = points[start[lo] + d]
            new = np.empty_like(band)
            left = np.full(len(q), 2, np.int8)
            for k in range(3):  # cell j = d + k of row d + 1
                j = d + k
                inside = (j >= 1) & (j <= free[q])
                same = np.zeros(len(q), bool)
                same[inside] = points[start[q[inside]] + j - 1] == letter[inside]
                diagonal = np.where(inside, band[:, k] + ~same, 2)
                above = band[:, k + 1] + 1 if k < 2 else np.full(len(q), 2)
                cell = np.minimum(np.minimum(diagonal, above), left + 1)
                cell = np.where((j <= free[q]) & (j >= 0), np.minimum(cell, 2), 2)
                new[:, k] = left = cell.astype(np.int8)
            stay = new.min(1) <= 1
            q, lo, hi, band = q[stay], lo[stay], hi[stay], new[stay]
    return np.concatenate(out_a) if out_a else np.zeros(0, np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64)


def _near(rows: pa.Table) -> pa.Table:
    """Near words of whole groups of candidates, sorted by key and free part."""
    key, words = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("word").combine_chunks()
    m, p, s, n = (rows.column(c).to_numpy() for c in ("m", "p", "s", "n"))
    points, off = _letters(words)
    start, size = off[:-1] + p, np.diff(off)
    a, b = near_pairs(key, size - p - s, start, points, size == m)
    # a pair of equal lengths is found from both sides, another from its shorter word
    twice = size[b] == size[a]
    common = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        d = common[open_]
        free = np.minimum(size[a[open_]] - p[a[open_]] - s[a[open_]], size[b[open_]] - p[b[open_]] - s[b[open_]])
        open_, d = open_[d < free], d[d < free]
        open_ = open_[points[start[a[open_]] + d] == points[start[b[open_]] + d]]
        common[open_] += 1
    own = (s[a] == 0) | (p[a] + common <= m[a] - s[a] - 1)  # else the pair belongs to another key
    a, b, twice = a[own], b[own], twice[own]
    x, y = np.concatenate((a, b[~twice])), np.concatenate((b, a[~twice]))
    return pa.table({"word": words.take(pa.array(x)), "n": pa.array(n[x]), "near": words.take(pa.array(y)), "near_n": pa.array(n[y])})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted partition; one that goes on in the next batch waits for it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch.column("key")[len(batch) - 1].as_py()
        new = int(np.searchsorted(np.asarray(pc.equal(batch.column("key"), last).to_numpy(zero_copy_only=False)), True))
        if kept and (new or kept[-1].column("key")[0].as_py() != last):
            kept.append(batch.slice(0, new))
            yield from _near(pa.Table.from_batches(kept)).to_batches()
            kept = []
        elif new:
            yield from _near(pa.Table.from_batches([batch.slice(0, new)])).to_batches()
        kept.append(batch.slice(new))
    if kept:
        yield from _near(pa.Table.from_batches(kept)).to_batches()


def near_words(vocab: DataFrame, length: int = 6, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n, near, near_n): every two words of ``vocab`` (word, n) exactly one edit apart, in both directions.

    ``vocab``: distinct words of at least ``length`` code points, without nulls.
    """
    ship(vocab)
    rows = candidates(vocab, length, most)
    dealt = rows.repartition("key").sortWithinPartitions("key", F.expr("substring(word, p + 1, length(word) - p - s)"))
    return dealt.mapInArrow(_scan, "word string, n long, near string, near_n long")


def variants(vocab: DataFrame, length: int = 6, times: int = 5, most: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab``, which is materialised.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if
    that is ``times`` its own n or more; its root is where forms lead in the end. Forms lead to
    ever commoner words, so there are no circles and few steps: roots pass on to the words that
    name them as form, of which a word has no more than it has near ones.
    """
    near = near_words(vocab, length, most)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = vocab.join(best, "word", "left")
    follows = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    words = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")))
    followers = words.where("form IS NOT NULL").select("word", "form")
    reached = words.where("form IS NULL").select("word", F.col("word").alias("root"))
    roots = reached
    while True:
        reached = cut(followers.join(reached.withColumnRenamed("word", "form"), "form").select("word", "root"))
        if reached.isEmpty():
            break
        roots = roots.unionByName(reached)
    return words.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, every: int = 199, length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """``variants`` of the words of whole texts, some of which are misspelt first (see ``misspelt``).

    Occurrences are counted before they are shuffled, so a word that holds a third of all is a
    row a task. Null texts have no words; repeated rows count each; texts of any length are
    whole. Columns other than doc_id and text are not looked at. An empty table has no words.
    """
    found = runs(docs)
    return variants(stored(vocabulary(found.select(misspelt(found, every).alias("word")), length, least)), length, times)
