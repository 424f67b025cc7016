"""Repeated runs of lines, found by winnowed line hashes and deleted but for the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, cut, looked_up, same, text_key

SPACE = r"[\x20\x09-\x0D]+"
#: A run of lines with so many words is found wherever it repeats (the guarantee) ...
RUN_WORDS = 50
#: ... by grams of consecutive lines with so many (the noise threshold).
GRAM_WORDS = 25
#: Positions of deleted lines, 4 bytes each, up to which they are broadcast to the texts.
BROADCAST_POSITIONS = 4_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, h, nw, at, k) of each line that has a word; equal rows count once.

    ``at`` is how many words of the text come before the line, ``k`` its number among these
    lines, from 1.
    """
    # white space at a line's ends doesn't tell lines apart
    line = F.trim("line", F.lit(" \t\n\v\f\r"))
    each = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", line).where("line <> ''")
    each = each.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", SPACE)).alias("nw"))
    once = each.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "pos"])
    order = _doc().orderBy("pos")
    before = F.sum("nw").over(order.rowsBetween(W.unboundedPreceding, -1))
    return once.select("*", F.coalesce(before, F.lit(0)).cast("int").alias("at"), F.row_number().over(order).alias("k"))


def _doc() -> WindowSpec:
    return W.partitionBy("doc_id", "text_key")


def fingerprints(lines: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, text_key, k, fp): the selected grams, each by its first line and its hash.

    A gram is the fewest lines from a line on that have ``gram_words`` words, a window the
    fewest that have ``run_words``. Of each window the gram of least hash within it is
    selected, the last of equal ones. Neighbouring windows mostly select the same, and equal
    windows select equal grams at equal places: so every repeated run of ``run_words`` words
    has a fingerprint in common with the run that it repeats.
    """
    order, end = _doc().orderBy("at"), F.max(F.col("at") + F.col("nw"))
    gram = order.rangeBetween(0, gram_words - 1)
    grams = lines.select("doc_id", "text_key", "k", "at", "nw", F.collect_list("h").over(gram).alias("own"), end.over(gram).alias("end"))
    grams = grams.select("doc_id", "text_key", "k", "at", "nw", "end", F.when(F.col("end") >= F.col("at") + gram_words, F.xxhash64("own")).alias("g"))
    window = order.rangeBetween(0, run_words - 1)
    held = grams.select("doc_id", "text_key", "at", F.collect_list(F.struct("g", (-F.col("k")).alias("back"), "end")).over(window).alias("held"), end.over(window).alias("to"))
    within = F.filter("held", lambda x: x["g"].isNotNull() & (x["end"] <= F.col("to")))
    least = held.where(F.col("to") >= F.col("at") + run_words).select("doc_id", "text_key", F.array_min(within).alias("least"))
    return least.select("doc_id", "text_key", (-F.col("least.back")).alias("k"), F.col("least.g").alias("fp")).distinct()


def _least_runs(lines: Column, spot: Column, run_words: int, gram_words: int) -> Column:
    """From the gram at line ``spot``, both ways to every least run of ``run_words`` words around it.

    A run is least if it has too few words without its first line, or without its last one.
    Two places that share the gram lie in equal runs of ``run_words`` or more just where some
    least runs around it are equal. Runs are numbers: first line * 2**20 + lines.
    """
    to = lambda x: x["at"] + x["nw"]
    here = F.element_at(lines, spot)
    ahead = F.filter(F.slice(lines, spot, gram_words + run_words), lambda x: x["at"] < to(here) + run_words)
    of_gram = F.size(F.filter(ahead, lambda x: x["at"] < here["at"] + gram_words))
    ends = F.slice(ahead, of_gram, run_words + 1)
    behind = F.slice(lines, F.greatest(F.lit(1), spot - run_words), F.least(spot, F.lit(run_words + 1)))
    starts = F.filter(behind, lambda x: x["at"] > here["at"] - run_words)
    enough = lambda i, j: (to(j) - i["at"] >= run_words) & ((j["at"] - i["at"] < run_words) | (to(j) - to(i) < run_words))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: enough(i, j)), lambda j: i["k"].cast("long") * (1 << 20) + (j["k"] - i["k"] + 1))))


def repeated_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, text_key, gone): sorted positions of the lines to delete, for documents with any.

    Fingerprints alone are dealt out and joined; lines are fetched for documents that have a
    repeated one, where matches grow both ways from its places.
    """
    lines = cut(lines_of(docs))
    prints = cut(fingerprints(lines, run_words, gram_words))
    again = prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    spots = looked_up(prints, again, "fp", "n").groupBy("doc_id", "text_key").agg(F.collect_set("k").alias("spots"))
    spots = cut(spots.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "spots"))
    is_doc = same(F.col("doc_id"), F.col("m_id")) & (F.col("text_key") == F.col("m_key"))
    near = lines.join(spots.select("m_id", "m_key"), is_doc, "left_semi")
    whole = near.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("k", "pos", "h", "nw", "at"))).alias("lines"))
    held = whole.join(spots, is_doc).select("doc_id", "text_key", "lines", F.array_distinct(F.flatten(F.transform("spots", lambda k: _least_runs(F.col("lines"), k, run_words, gram_words)))).alias("runs"))
    first, size = lambda r: F.shiftright(r, 20).cast("int"), lambda r: r.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
    held = held.select("doc_id", "text_key", "runs", F.transform("lines", lambda x: x["h"]).alias("h"), F.transform("lines", lambda x: x["pos"]).alias("at"))
    run = lambda r: F.struct(first(r).alias("k"), size(r).alias("m"), F.xxhash64(F.slice("h", first(r), size(r))).alias("run"), F.slice("at", first(r), size(r)).alias("own"))
    runs = cut(held.select("doc_id", "text_key", F.explode(F.transform("runs", run)).alias("r")).select("doc_id", "text_key", "r.*"))
    source = runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "k")).alias("src")).where("n > 1")
    own_doc = same(F.col("doc_id"), F.col("src.doc_id")) & (F.col("text_key") == F.col("src.text_key"))
    # a run must not overlap what it repeats
    later = looked_up(runs, source, "run", "n").where(~own_doc | (F.col("k") >= F.col("src.k") + F.col("m")))
    return later.select("doc_id", "text_key", F.explode("own").alias("pos")).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """The documents without later repeats of runs of ``run_words`` words or more.

    A run is consecutive lines, blank ones aside, that have ``run_words`` words or more. A
    line is deleted if it lies in a run that stands earlier as well, in order of doc_id (null
    first) and line: in another document, or further up in the same one without overlap.
    Every deleted line has an equal one that stays, as each points to an earlier one.

    Returns the document columns and n_deleted; n_chars is that of the new text. A document
    all of whose lines repeat stays with empty text. Null and wordless texts are unchanged.
    Very long texts are compared whole; a document's lines meet in one task, and no run of
    more lines than ``gram_words + run_words`` is looked at at once. Of equal runs in one
    document the first stays (ties). Rows equal in doc_id and text are one document and
    change alike. Other columns are dropped. An empty table gives none.
    """
    gone = cut(repeated_lines(docs, run_words, gram_words).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "gone"))
    if (gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0) <= BROADCAST_POSITIONS:
        gone = F.broadcast(gone)
    joined = docs.select(*DOCUMENT_COLUMNS, text_key().alias("text_key")).join(gone, same(F.col("doc_id"), F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: split[i]), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    out = joined.select("doc_id", text.alias("text"), "lang", "source", F.col("n_chars").alias("chars"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("chars"))
    return out.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"), "n_deleted")
