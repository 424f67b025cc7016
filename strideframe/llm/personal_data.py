"""Personal data, and the terms around it that give it away, found and generalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, looked_up, same, small, text_key

#: Patterns of the base kinds, in their order. Possessive groups match the same text as greedy
#: ones here, and Java runs them without a stack frame for each repeat.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a kind's pattern can't match anything valid.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = "term"
#: Words on each side of an entity that count as its company, and the letters a term has at least.
REACH, LETTERS = 5, 4
#: Texts in which a term must accompany an entity before anything is said about them.
SUPPORT = 3
#: Share of an entity's information content that a term may give away.
DISCLOSURE = 0.9

_HITS = "array<struct<kind:string,start:int,end:int,entity:string,near:array<string>>>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _words(text: Column) -> Column:
    """Terms of a text: lower-cased runs of letters, long enough."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= LETTERS)


def _nearby(parts: Column) -> Column:
    """The first and last REACH words of each part of a text, which addresses of one kind divide."""
    plain = lambda p: F.filter(F.split(F.regexp_replace(p, KINDS["email"], " "), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.transform(parts, plain), lambda w: F.struct(F.slice(w, 1, REACH).alias("head"), F.slice(w, F.greatest(F.lit(1), F.size(w) - REACH + 1), F.lit(REACH)).alias("tail")))


def _company(near: Column, i: Column) -> Column:
    """Terms among the REACH words on each side of match ``i``; another address is a word without terms."""
    gap = F.array(F.lit(""))
    before = F.flatten(F.transform(F.slice(near, F.greatest(F.lit(1), i + 1 - REACH), F.least(i + 1, F.lit(REACH + 1))), lambda x: F.concat(x["tail"], gap)))
    after = F.flatten(F.transform(F.slice(near, i + 2, F.lit(REACH + 1)), lambda x: F.concat(gap, x["head"])))
    n = F.size(before)
    close = F.concat(F.slice(before, F.greatest(F.lit(1), n - REACH), F.least(F.lit(REACH), n - 1)), F.slice(after, F.lit(2), F.lit(REACH)))
    return F.array_distinct(_words(F.array_join(close, " ")))


def _starts(parts: Column, found: Column) -> Column:
    """Where each match starts: after all parts and matches before it."""
    zero = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("at"))
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("p"), found.alias("m"))
    step = lambda a, x: F.struct(F.concat(a["all"], F.array(a["at"] + F.length(x["p"]))).alias("all"), (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"))
    return F.aggregate(pairs, zero, step, lambda a: a["all"])


def _split(text: Column, pattern: Column | str, some: Column) -> tuple[Column, Column]:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(some, F.split(text, pattern, -1)), F.when(some, F.regexp_extract_all(text, pattern, F.lit(0)))


def _hits(kind: str) -> Column:
    """The valid matches of one kind, from what is near them, the matches and their starts."""
    near, starts = F.col(f"{kind}_near"), F.col(f"{kind}_starts")
    hit = lambda v, i: F.struct(F.lit(kind).alias("kind"), starts[i].alias("start"), (starts[i] + F.length(v)).alias("end"), v.alias("entity"), _company(near, i).alias("near"))
    return F.filter(F.transform(F.col(f"{kind}_found"), hit), lambda x: _valid(kind, x["entity"]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, hits): base spans by kind and start, with their company; one narrow pass."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in KINDS.items():
        parts, found = _split(F.col("text"), pattern, GUARDS[kind](F.col("text")))
        rows = rows.withColumns({f"{kind}_parts": parts, f"{kind}_found": found})
        rows = rows.withColumns({f"{kind}_starts": _starts(F.col(f"{kind}_parts"), F.col(f"{kind}_found")), f"{kind}_near": _nearby(F.col(f"{kind}_parts"))})
    lists = [F.coalesce(_hits(kind).cast(_HITS), F.array().cast(_HITS)) for kind in KINDS]
    return rows.select("doc_id", "text_key", F.concat(*lists).alias("hits"))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, entity) of terms that give an entity away.

    A term's pointwise mutual information with an entity, over the texts that hold each and
    those in which they stand close, is the information on the entity that the term gives.
    A term is disclosing if that is the given share of all there is, -log p(entity), in
    ``support`` texts or more. Copies of a text count once.
    """
    counts = cut(found.groupBy("text_key").agg(F.count("*").alias("copies")))
    total = counts.count()
    own = found.where(F.size("hits") > 0).dropDuplicates(["text_key"]).select("text_key", F.explode("hits").alias("h"))
    company = cut(own.select("text_key", F.lower("h.entity").alias("entity"), "h.near"))
    with_entity = company.groupBy("entity").agg(F.count_distinct("text_key").alias("n_c"), F.count("*").alias("rows")).where(F.col("n_c") >= support)
    close = looked_up(company, with_entity, "entity", "rows").select("text_key", "entity", "n_c", F.explode("near").alias("term")).distinct()
    pairs = cut(close.groupBy("entity", "term", "n_c").agg(F.count("*").alias("n_tc")).where(F.col("n_tc") >= support))
    asked = pairs.groupBy("term").agg(F.count("*").alias("rows"))
    # every copy of a text counts its share, so that the text counts once; words are summed where they are read
    copied = counts.where("copies > 1").select("text_key", (1 / F.col("copies")).alias("share"), "copies")
    texts = docs.select("text", text_key().alias("text_key"))
    shared = looked_up(texts, copied, "text_key", "copies", "left").select(F.coalesce("share", F.lit(1.0)).alias("share"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    # a row a term on both sides; a term near very many entities then goes to its pairs apart
    with_term = shared.groupBy("term").agg(F.round(F.sum("share")).alias("n_t")).join(asked, "term")
    log = lambda c: F.log(c.cast("double"))
    given = log(F.col("n_tc")) + log(F.lit(total)) - log(F.greatest("n_t", "n_tc")) - log(F.col("n_c"))
    return looked_up(pairs, with_term, "term", "rows").where((F.col("n_c") < total) & (given >= disclosure * (log(F.lit(total)) - log(F.col("n_c"))))).select("term", "entity")


def find_personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """All spans of every document: base kinds, then terms that disclose an entity in it.

    Positions are code points, end exclusive. Base kinds are found on their own, so spans of
    two kinds may overlap; a term that overlaps a base span is left out. Terms count only in
    documents that hold the entity they give away; others stay as they are.

    Null text is empty. Very long texts are scanned whole. Rows equal in doc_id and text get
    equal results, one each; copies of a text count once in the statistics. Columns other
    than doc_id and text are not looked at. An empty table gives none.
    Returns doc_id, text_key, spans: array of (kind, start, end).
    """
    found = cut(scan(docs))
    terms = small(disclosing_terms(docs, found, support, disclosure))
    guarded = F.lit(False)
    for test in GUARDS.values():
        guarded = guarded | test(F.col("text"))
    entities = F.array_distinct(F.transform("hits", lambda h: F.lower(h["entity"])))
    holders = found.where(F.size("hits") > 0).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "hits", entities.alias("entities"))
    texts = docs.where(guarded).select("doc_id", "text", text_key().alias("text_key")).join(holders, same(F.col("doc_id"), F.col("f_id")) & (F.col("text_key") == F.col("f_key")))
    said = texts.select("f_id", "f_key", "entities", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(terms, "term").where(F.array_contains("entities", F.col("entity")))
    told = said.groupBy("f_id", "f_key").agg(F.collect_set("term").alias("terms")).withColumnsRenamed({"f_id": "t_id", "f_key": "t_key"})
    told = texts.drop("doc_id", "text_key", "entities").dropDuplicates(["f_id", "f_key"]).join(small(told, F.size("terms")), same(F.col("f_id"), F.col("t_id")) & (F.col("f_key") == F.col("t_key")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array("terms"), "|"), F.lit(r")(?!\p{L})"))
    told = told.withColumn("pattern", pattern)
    parts, matches = _split(F.col("text"), F.col("pattern"), F.lit(True))
    told = told.withColumns({"parts": parts, "matches": matches})
    told = told.withColumn("starts", _starts(F.col("parts"), F.col("matches")))
    spans = F.transform("matches", lambda v, i: F.struct(F.lit(TERM).alias("kind"), F.col("starts")[i].alias("start"), (F.col("starts")[i] + F.length(v)).alias("end")))
    apart = F.filter(spans, lambda s: ~F.exists("hits", lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"])))
    added = told.select(F.col("f_id").alias("a_id"), F.col("f_key").alias("a_key"), apart.alias("added"))
    base = F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    out = found.join(added, same(F.col("doc_id"), F.col("a_id")) & (F.col("text_key") == F.col("a_key")), "left")
    return out.select("doc_id", "text_key", F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Of each row of ``find_personal_data``: counts by kind, a checksum of base spans, and all spans as text.

    A text without spans, null and empty ones among them, has the checksum of the empty list.
    Spans of one place (ties) go by kind. Repeated rows give equal ones; an empty table none.
    """
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The documents with every span generalised to its kind, as ``[EMAIL]``; other columns unchanged, whatever their names.

    Of spans that overlap the first is replaced whole, and the others' rest isn't. Null texts
    stay null; texts without spans, empty ones among them, stay as they are. Repeated rows
    change alike. An empty table gives none. Long texts are rewritten whole, in one pass.
    """
    found = find_personal_data(docs, support, disclosure).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select("doc_id", "text_key", F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    d, f = docs.alias("d"), found.alias("f")
    joined = d.join(f, same(F.col("d.doc_id"), F.col("f.doc_id")) & (text_key("d.text") == F.col("f.text_key")), "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text, spans = F.col("d.text"), F.col("f.spans")
    piece = lambda a, s: F.substring(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
    step = lambda a, s: F.struct(F.concat(a["out"], piece(a, s), F.when(s["start"] >= a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.select(*[F.when(spans.isNull(), text).otherwise(done).alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
