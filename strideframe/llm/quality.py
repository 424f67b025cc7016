"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, cut, same, small, stored, text_key

SPACE = r"[\x20\x09-\x0D]+"
#: Items a sketch keeps; a group of fewer rows has exact quantiles.
SKETCH_K = 1024
#: A group of fewer documents takes its language's thresholds, or those of the corpus.
MIN_GROUP = 200
#: Measures, all on a logarithmic scale: quartile ranges beyond the quartiles at which a document
#: is far out, below (None: never) and above, and what a quartile range counts as at least,
#: against groups without any spread.
MEASURES = {"word_length": (4.0, 4.0, 0.03), "symbols": (None, 3.0, 0.3), "dup_lines": (None, 3.0, 0.3), "repeats": (None, 3.0, 0.3)}


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that the text holds twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def features(docs: DataFrame, *more: str) -> DataFrame:
    """Word statistics of each whole text; one narrow pass, no shuffle.

    Null text counts as empty: all counts 0. Returns doc_id, lang, source, text_key,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, and ``more``
    columns of documents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.trim(line, F.lit(" \t\n\v\f\r")) != ""
    carried = [c for c in more if c != "text"]
    words = docs.select("doc_id", "lang", "source", *carried, text_key().alias("text_key"), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    words = words.withColumn("lines", F.filter(F.split("text", "\n"), has_word))
    words = words.withColumn("hashes", _repeat_words(F.col("words")))
    twice = words.withColumn("twice", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    at = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    runs = twice.withColumn("pairs", F.when(F.col("twice"), F.sort_array(at)))
    h = lambda i: F.try_element_at("pairs", i)["h"]
    repeated = F.filter("pairs", lambda p, k: F.coalesce(p["h"] == h(k + 2), F.lit(False)) | F.when(k > 0, p["h"] == h(F.greatest(k, F.lit(1)))).otherwise(False))
    spots = runs.withColumn("spots", F.sort_array(F.transform(repeated, lambda p: p["i"])))
    covered = F.aggregate(F.transform("spots", lambda s, k: F.least(F.lit(3), F.coalesce(F.try_element_at("spots", k + 2) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return spots.select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        *more,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("twice"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures(df: DataFrame) -> DataFrame:
    """Adds the MEASURES: logarithms of characters a word, and of smoothed rates.

    A little is added to each count, and to what it is a share of. So most documents of a
    group, which have no symbols and no repeats at all, still differ by their length, quartiles
    have a spread, and a single chance repeat isn't far out.
    """
    rate = lambda n, of, few, more: F.log((F.col(n) + float(few)) / (F.col(of) + float(more)))
    length = F.log(F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(1.0)))
    return df.withColumns({"word_length": length, "symbols": rate("n_symbols", "word_chars", 1, 100), "dup_lines": rate("n_dup_lines", "n_lines", 1, 10), "repeats": rate("n_repeat_words", "n_words", 5, 100)})


def thresholds(scored: DataFrame, k: int = SKETCH_K, min_group: int = MIN_GROUP) -> DataFrame:
    """Bounds of each measure per (lang, source), from mergeable quantile sketches.

    ``scored`` should be materialised, as it is read more than once. The documents that pass
    the base rule count. A bound lies some quartile ranges beyond the group's quartile. Each
    task sketches its own rows, so a source with a third of all rows arrives as one sketch a
    task. Sketches of sources merge into their language's, those into the corpus's; a group of
    fewer than ``min_group`` such documents takes its language's bounds, or the corpus's. A
    null lang or source is a group of its own.
    """
    sound = scored.where(~base_failed())
    sketched = sound.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, F.lit(k)).alias(c) for c in MEASURES])
    by_source = cut(sketched)
    merged = lambda df: [F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in MEASURES]]
    by_lang = by_source.groupBy("lang").agg(*merged(by_source))

    def bounds(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
        q = lambda c, r: F.kll_sketch_get_quantile_double(c, F.lit(r))
        spread = lambda c: F.greatest(F.lit(MEASURES[c][2]), q(c, 0.75) - q(c, 0.25))
        sides = [x for c, (low, high, _) in MEASURES.items() for x in ((q(c, 0.75) + high * spread(c)).alias(f"{tag}_max_{c}"), (q(c, 0.25) - low * spread(c) if low else F.lit(float("-inf"))).alias(f"{tag}_min_{c}"))]
        return df.select(*keys, F.col("n").alias(f"{tag}_n"), *sides)

    s, g = bounds(by_source, "s", ["lang", "source"]), bounds(by_lang, "g", ["lang"]).withColumnRenamed("lang", "g_lang")
    overall = bounds(by_lang.agg(*merged(by_lang)).where("n > 0"), "o", []).first()  # a few numbers
    names = [f"{side}_{c}" for c in MEASURES for side in ("max", "min")]
    both = s.join(g, same(F.col("lang"), F.col("g_lang")), "left")
    pick = lambda c: F.when(F.col("s_n") >= min_group, F.col(f"s_{c}")).when(F.col("g_n") >= min_group, F.col(f"g_{c}")).otherwise(F.lit(overall[f"o_{c}"] if overall else None).cast("double"))
    return both.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[pick(c).alias(c) for c in names])


def _judged(scored: DataFrame, **options) -> DataFrame:
    """``scored``, which is materialised, with base_failed and kept."""
    limits = small(thresholds(scored, **options))
    judged = scored.join(limits, same(F.col("lang"), F.col("t_lang")) & same(F.col("source"), F.col("t_source")), "left")
    within = F.lit(True)
    for c in MEASURES:
        within = within & F.col(c).between(F.col(f"min_{c}"), F.col(f"max_{c}"))
    return judged.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & within})


def quality_verdicts(docs: DataFrame, **options) -> DataFrame:
    """Statistics, base rule and verdict of every document.

    A document that fails the base rule is never kept. Others are kept unless a measure lies
    beyond a threshold of its (lang, source); a value on the threshold is kept (ties).
    Nulls: null text is empty and fails; null lang or source form groups. Repeated rows each
    get a row. Very long texts are measured whole. Columns other than doc_id, text, lang and
    source are not looked at. An empty table gives an empty result.
    """
    judged = _judged(cut(measures(features(docs))), **options)
    return judged.select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``quality_verdicts`` keeps, in the columns of documents, unchanged.

    Texts are stored once beside their statistics, so that the verdicts filter them without a
    shuffle. Null, empty and short texts go with the base rule. Rows equal in doc_id and text
    are in or out together. Very long texts are judged whole. Other columns, whatever their
    names, are dropped. An empty table gives none.
    """
    return _judged(stored(measures(features(docs, "text", "n_chars"))), **options).where("kept").select(*DOCUMENT_COLUMNS)
