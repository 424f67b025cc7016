"""A dataset's Merkle manifest: a tree of row digests for each group, one tree over their roots, and proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, small, stored

#: Nodes that are hashed together.
FANOUT = 2
#: Levels that one grouping builds, and one join attaches; a group has FANOUT**BAND nodes at most.
BAND = 5

_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _none() -> Column:
    return F.unhex(F.lit(""))


def leaf(*fields: Column) -> Column:
    """Binary SHA-256 of a row: of each field ``-`` if null, else its UTF-8 byte count, a colon, and itself."""

    def framed(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[framed(c.cast("string")) for c in fields]), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(nodes: Column) -> Column:
    return F.aggregate(nodes, _none(), lambda all_, c: F.concat(all_, c["digest"]))


def _parent(children: Column) -> Column:
    plain = F.transform(children, lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi"), c["digest"].alias("digest")))
    return F.struct(children[0]["lo"].alias("lo"), F.element_at(children, -1)["hi"].alias("hi"), F.unhex(F.sha2(hexed(_joined(children)), 256)).alias("digest"), plain.alias("children"))


def _parents(nodes: Column, starts: Column, fanout: int) -> Column:
    return F.transform(F.transform(starts, lambda i: F.slice(nodes, i, fanout)), _parent)


def _labelled(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda x: F.struct(F.lit(level).alias("level"), x.alias("x")))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (first place of its tree among all rows), ``size`` of the tree and ``lo`` (place there, from 0).

    The column named ``tree`` has no nulls and its trees follow each other; ``order`` orders
    the rows of one and should leave no ties. Rows are sorted in ranges, whose sizes give each
    range's first place, so no tree has to fit a task.
    """
    keys = [tree, *order]
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    # as many rows as ranges, each the sum of ranges before it
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.expr("sum(_n) OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    placed = dealt.join(small(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))), "_range").withColumn("_at", F.col("_before") + F.col("_at")).drop("_range", "_before")
    trees = placed.groupBy(F.col(tree).alias("_tree")).agg(F.min("_at").alias("tree"), F.count("*").alias("size"), F.count("*").alias("_n"))
    return looked_up(placed.withColumnRenamed(tree, "_tree"), trees, "_tree", "_n").withColumn("lo", F.col("_at") - F.col("tree")).drop("_at", "_tree")


def _built(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """The nodes of BAND levels above ``nodes``, as far as their trees reach: intervals of leaves, digests, children."""
    width = fanout ** (level + BAND)
    rows = nodes.groupBy("tree", "size", F.expr(f"lo div {width}").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("_0"))
    for k in range(1, BAND + 1):
        below = F.col(f"_{k - 1}")
        # a tree has a level only if it has several nodes on the one below
        starts = F.when(F.col("size") > fanout ** (level + k - 1), F.sequence(F.lit(1), F.size(below), F.lit(fanout))).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn(f"_{k}", _parents(below, starts, fanout))
    levels = [_labelled(F.col(f"_{k}"), level + k) for k in range(1, BAND + 1)]
    out = rows.select("tree", "size", F.explode(F.concat(*levels)).alias("n")).select("tree", "size", "n.level", "n.x.*")
    widths = F.map_from_arrays(F.array(*[F.lit(level + k) for k in range(1, BAND + 1)]), F.array(*[F.lit(fanout ** (level + k)).cast("long") for k in range(1, BAND + 1)]))
    return stored(out.withColumn("bucket", F.floor(F.col("lo") / widths[F.col("level")]).cast("long")))


def _attached(nodes: DataFrame, above: DataFrame, level: int, fanout: int, payload: list[str]) -> DataFrame:
    """``nodes`` with ``path``: of each of BAND levels what stands beside their ancestor below its parent.

    A node looks for the ancestor of each level in the bucket of that level's width and takes
    the one whose interval holds its own. What the parent's interval has beyond that of the
    child which holds the node are the siblings before and after it.
    """
    levels = F.array(*[F.struct(F.lit(level + k).alias("level"), F.lit(fanout ** (level + k)).cast("long").alias("width")) for k in range(1, BAND + 1)])
    each = nodes.select("tree", "size", "lo", "hi", F.struct(*payload).alias("_kept"), F.posexplode_outer(F.filter(levels, lambda x: x["width"] / fanout < F.col("size"))).alias("_k", "_l"))
    # what a row carries goes with its first level alone
    each = each.select("tree", "size", "lo", "hi", F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("_kept")).alias("_kept"), F.col("_l.level").alias("level"), F.floor(F.col("lo") / F.col("_l.width")).cast("long").alias("bucket"))
    up = above.select("tree", "level", "bucket", F.col("lo").alias("_from"), F.col("hi").alias("_to"), "children")
    met = each.alias("d").join(up.alias("u"), ["tree", "level", "bucket"], "left").where("_from IS NULL OR (_from <= lo AND hi <= _to)")
    beside = F.struct("level", _joined(F.filter("children", lambda c: c["hi"] <= F.col("lo"))).alias("before"), _joined(F.filter("children", lambda c: c["lo"] >= F.col("hi"))).alias("after"))
    return met.groupBy("tree", "size", "lo", "hi").agg(F.sort_array(F.collect_list(F.when(F.col("_from").isNotNull(), beside))).alias("path"), F.first("_kept", ignorenulls=True).alias("_kept")).select("tree", "size", "lo", "hi", "path", "_kept.*")


def forest(leaves: DataFrame, payload: list[str], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Proof paths of the leaves of many trees, and their roots.

    ``leaves``: as ``ranked`` gives them, with ``digest``. The first table has tree, size, lo,
    ``payload`` and ``path``: from the leaf upward, the siblings' digests ``before`` and
    ``after`` it on each level, empty where it is alone. The second has tree, size and digest.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    leaves = leaves.withColumn("hi", F.col("lo") + 1)
    bottom, bands, roots = leaves, [], [leaves.where("size = 1").select("tree", "size", "digest")]
    while fanout ** (BAND * len(bands)) < most:
        level = BAND * len(bands)
        above = _built(bottom, level, fanout)
        bands.append((bottom, above, level))
        roots.append(above.where("hi - lo = size").select("tree", "size", "digest"))
        bottom = above.where((F.col("level") == level + BAND) & (F.col("hi") - F.col("lo") < F.col("size")))
    paths = None
    for nodes, above, level in reversed(bands):
        found = _attached(nodes, above, level, fanout, payload if level == 0 else [F.lit(0).alias("_")])
        if paths is not None:
            up = paths.select("tree", F.expr(f"lo div {fanout ** (level + BAND)}").alias("_b"), F.col("path").alias("_up"))
            found = found.withColumn("_b", F.expr(f"lo div {fanout ** (level + BAND)}")).join(up, ["tree", "_b"], "left")
            found = found.withColumn("path", F.when(F.col("_up").isNull(), F.col("path")).otherwise(F.concat("path", "_up"))).drop("_b", "_up")
        paths = stored(found.drop("_"))
    if paths is None:
        paths = leaves.select("tree", "size", "lo", "hi", F.array().cast("array<struct<level:int,before:binary,after:binary>>").alias("path"), *payload)
    all_roots = roots[0]
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r)
    return paths.select("tree", "size", "lo", *payload, "path"), all_roots


def folded(digest: Column, path: Column) -> Column:
    """Root in hex that a leaf's binary digest gives with the siblings of its path."""
    return F.aggregate(path, hexed(digest), lambda own, s: F.sha2(F.concat(hexed(s["before"]), own, hexed(s["after"])), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in one hex text, level by level, left to right."""
    return hexed(F.aggregate(path, _none(), lambda all_, s: F.concat(all_, s["before"], s["after"])))


def manifest(docs: DataFrame, group: str = "lang", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Of every row: doc_id, ``carry``, leaf, subroot, root (binary) and path, from its leaf to the root.

    A tree for each ``group`` (a string; null is a group, the first), rows in order of doc_id
    (nulls first), rows of one doc_id in order of their leaves; equal rows are leaves each.
    While several nodes remain, each run of ``fanout`` becomes their digest, a shorter last run
    too. The subroots, in order of their groups, make one more tree. Texts are read once, in
    whole; everything after that handles digests. Other columns than those of documents and
    ``carry``'s are not looked at. An empty table has no rows.
    """
    carry = carry or {}
    fields = docs.select(F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-")).alias("_group"), leaf(*map(F.col, _FIELDS)).alias("digest"), *[c.alias(k) for k, c in carry.items()])
    rows = stored(fields.withColumn("_row", F.monotonically_increasing_id()))  # tells equal rows apart
    kept = ["doc_id", *carry, "digest"]
    leaves = stored(ranked(rows, "_group", ["doc_id", "digest", "_row"]).drop("_row"))
    paths, roots = forest(leaves, kept, fanout)
    roots = stored(roots.select(F.col("tree").alias("_of"), F.col("size").alias("_n"), "digest", F.lit("").alias("_all")))
    top_paths, top = forest(stored(ranked(roots, "_all", ["_of"])), ["_of", "_n", "digest"], fanout)
    tops = top_paths.join(top.select("tree", F.col("digest").alias("root")), "tree")
    tops = tops.select(F.col("_of").alias("tree"), "_n", F.col("digest").alias("subroot"), F.col("path").alias("_top"), "root")
    whole = looked_up(paths, tops, "tree", "_n")
    return whole.select("doc_id", *carry, F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "_top").alias("path"))


def changed(every: int = 7) -> Column:
    """The leaf of a document, n_chars one higher where ``every`` divides the CRC-32 of its decimal doc_id.

    Null counts stay null; a null doc_id is never changed.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    count = F.col("n_chars").cast("decimal(20,0)")
    return leaf(*[F.when(hit, count + 1).otherwise(count) if c == "n_chars" else F.col(c) for c in _FIELDS])


def digest(found: DataFrame) -> DataFrame:
    """Hex digests of a manifest that carries ``tampered``, and whether those leaves still fold to the root."""
    out = found.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

