"""Benchmark passages in documents, by a set join on each window's rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, DOCUMENT_COLUMNS, cut, frequent, in_shares, same, small, stored, text_key

#: Characters that part words: ASCII other than digits and lower-case letters.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Java's lower() changes these too, which only A-Z should be.
_OTHER_CAPITALS = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a text; null and wordless texts have none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, PARTS), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of the benchmark: (window, items), items sorted ids that hold it.

    A window is ``width`` consecutive words; an item of fewer is one window, a wordless one
    none. Windows shared by several items are searched once.
    """
    spelled = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    spelled = spelled.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    each = spelled.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Prefix filter for exact containment: ordered by rarity in the documents, a window's first
    word alone must occur, so only that one is joined. Where it occurs, its offset fixes the
    window's place; windows that don't fit between the text's ends go (positional and length
    bounds), and the rest are compared word by word. Texts are split into words once; these
    are stored. The benchmark is broadcast only if its windows, and the items that hold them,
    are few enough; else words, each with those around it, are shuffled to the windows, those
    of a frequent word in shares.

    Null or wordless texts have n_words 0. Repeated rows get equal results, and windows that
    overlap or repeat (ties) count each word once. Very long texts are compared whole. Null
    item ids are left out of the lists. Columns other than doc_id, text and item_id, text are
    not looked at. Empty tables: no documents give no rows, no benchmark gives no hits.
    """
    base = stored(docs.select("doc_id", text_key().alias("text_key"), words_of(F.col("text")).alias("words")))
    windows = cut(item_windows(benchmark, width))
    vocabulary = cut(windows.select(F.explode("window").alias("word")).distinct())
    said = base.select(F.explode("words").alias("word"))
    if vocabulary.count() <= BROADCAST_ROWS:
        used = said.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()
    else:
        # counted before they are joined, so that a common word is one row of each task
        used = said.groupBy("word").count().join(vocabulary, "word", "left_semi")
    places = windows.select("window", "items", F.posexplode("window").alias("at", "word"))
    ranked = places.join(used, "word").groupBy("window", "items").agg(F.count("*").alias("known"), F.min(F.struct("count", "at", "word")).alias("rare"))
    # a window with a word that no document has can't occur
    prefixes = cut(ranked.where(F.col("known") == F.size("window")).select("window", "items", "rare.at", F.col("rare.word").alias("rare"), "rare.count"))
    few = (prefixes.agg(F.sum(1 + F.size("items"))).first()[0] or 0) <= BROADCAST_ROWS
    begin = F.col("pos") - F.col("at")
    probe = base.select("doc_id", "text_key", F.size("words").alias("n"), "words", F.lit(0).alias("from"), F.posexplode("words").alias("pos", "word"))
    if not few:
        # of a long text, a row takes only the words that a window about this one can have
        first = F.greatest(F.lit(0), F.col("pos") - width + 1)
        probe = probe.select("doc_id", "text_key", "n", F.slice("words", first + 1, F.lit(2 * width - 1)).alias("words"), first.alias("from"), "pos", "word")
        # windows of common words alone: the words go in shares, to as many copies of the windows
        counts = prefixes.select(F.col("rare").alias("word"), "count").distinct()
        hot = F.broadcast(cut(frequent(counts, "word", "count")).withColumnRenamed("count", "of_word"))
        one = F.coalesce("of_word", F.lit(1))
        places = prefixes.withColumnRenamed("rare", "word").drop("count").join(hot, "word", "left").withColumn("of_word", one)
        met = in_shares(probe.join(hot, "word", "left").withColumn("of_word", one), places, ["word"], "of_word", ["doc_id", "text_key", "pos"])
    else:
        met = probe.join(F.broadcast(prefixes), probe["word"] == prefixes["rare"])
    met = met.where((begin >= 0) & (begin + F.size("window") <= F.col("n"))).where(F.slice("words", begin - F.col("from") + 1, F.size("window")) == F.col("window"))
    found = met.select("doc_id", "text_key", begin.alias("begin"), (begin + F.size("window")).alias("end"), "items")
    # copies of a row find the same places twice: once is enough
    spans = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    reach = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    counted = F.aggregate("spans", reach, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    hits = spans.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), counted.cast("long").alias("n_hit"), "item_ids", "spans")
    sizes = base.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    out = sizes.join(hits, same(F.col("doc_id"), F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Of each row of ``find_passages``: counts, a checksum of its sorted item ids, and whether it is hit.

    A text without hits, null and empty ones among them, has the checksum of the empty list.
    Repeated rows give equal ones; long texts have one row like all; an empty table gives none.
    """
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, in the columns of documents, unchanged.

    Null, empty and wordless texts stay. Rows equal in doc_id and text stay or go together.
    Very long texts are searched whole. Other columns, whatever their names, are dropped. No
    documents give none, no benchmark drops none.
    """
    hit = find_passages(docs, benchmark, width).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(small(hit), same(F.col("doc_id"), F.col("hit_id")) & (text_key() == F.col("hit_key")), "left_anti")
