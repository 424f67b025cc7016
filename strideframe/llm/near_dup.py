"""Near-duplicate documents by one-permutation MinHash, banded buckets, star edges and full blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, cut, in_shares, looked_up, same, ship, small, text_key
from .ragged import CHUNK_BYTES, U, buffers, chunks, mix, shingles, words

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: Sketches that agree in fewer bins than this are not compared in full: at similarity 0.75
#: a pair falls below it once in about 10**10 times.
MIN_AGREE = 64
#: Buckets of up to so many classes compare every pair at once; larger ones begin with stars.
PAIRS_UP_TO = 32
#: Members of a block, and their shingles, about: larger buckets then compare block with block.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Shingles that fewer than one in so many pairs of a block share are counted pair by pair.
RARE = 256
#: By how much chance moves the second hub of a bucket.
SPREAD = 0.3
#: Links that a task of the component steps reads, so that few links make few tasks.
LINKS_A_TASK = 20_000
_EMPTY = U(2**64 - 1)

_SKETCH = "doc_id long, text_key long, n_shingles long, class_id long, sketch binary, bands array<long>"


def densified(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each bin over sorted distinct hashes; an empty bin borrows.

    Optimal densification: bin i probes bins chosen by a hash of (i, attempt) until one is
    filled, so that every bin draws anew and variance stays that of independent bins.
    """
    at = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << U(57))
    value = np.where(at < len(hashes), hashes[np.minimum(at, len(hashes) - 1)], _EMPTY)
    full = (at < len(hashes)) & ((value >> U(57)) == np.arange(BINS, dtype=np.uint64))
    out, attempt, empty = value.copy(), 0, np.flatnonzero(~full)
    while len(empty):
        probe = (mix(empty.astype(np.uint64) * U(1 << 20) + U(attempt + 1)) % U(BINS)).astype(np.int64)
        hit = full[probe]
        out[empty[hit]] = value[probe[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = mix(np.arange(1, BINS + 1, dtype=np.uint64))
    for batch in batches:
        for i, j, raw, off in chunks(batch.column("text")):
            found, row = shingles(words(raw, off))
            n = j - i
            size, ident, sketch = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, BINS), np.uint64)
            for k in range(n):
                if row[k] < row[k + 1]:
                    own = np.unique(found[row[k] : row[k + 1]])
                    size[k] = len(own)
                    ident[k] = mix(np.sum(mix(own ^ U(0x51ED270B)), keepdims=True) + U(len(own))).view(np.int64)[0]
                    sketch[k] = densified(own)
            keys = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                keys = mix(keys * U(0x9E3779B97F4A7C15) + sketch[:, r::ROWS] + salts[:BANDS])
            none = size == 0
            short = np.ascontiguousarray((mix(sketch) >> U(56)).astype(np.uint8))
            bands = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], batch.column("text_key")[i:j], pa.array(size), pa.array(ident, mask=none), pa.array([x.tobytes() for x in short], pa.binary()), bands],
                names=["doc_id", "text_key", "n_shingles", "class_id", "sketch", "bands"],
            )


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of pairs, cut so that the texts of each are some megabytes (one pair at least)."""
    for batch in batches:
        size = sum(np.diff(buffers(batch.column(c))[1]) for c in ("text_a", "text_b"))
        upto = np.concatenate(([0], np.cumsum(size)))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + 2 * CHUNK_BYTES, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose full sets reach the similarity."""
    for batch in _sliced(batches):
        sets: dict[int, np.ndarray] = {}

        def own(ids: list[int], texts: pa.Array, sets: dict[int, np.ndarray] = sets) -> None:
            new = {c: k for k, c in enumerate(ids) if c not in sets}
            some = texts.take(pa.array(list(new.values()), pa.int64()))
            names = list(new)
            for i, j, raw, off in chunks(some):
                found, row = shingles(words(raw, off))
                for k in range(j - i):
                    sets[names[i + k]] = np.unique(found[row[k] : row[k + 1]])

        left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        own(left, batch.column("text_a"))
        own(right, batch.column("text_b"))
        keep = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            keep.append(100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``; exact."""
    shape = len(left), len(right)
    i, j = (np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right))
    names, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    n_a, n_b = np.bincount(a, minlength=len(names)), np.bincount(b, minlength=len(names))
    common = n_a * n_b * RARE >= shape[0] * shape[1]
    out = np.zeros(shape, np.float32)
    place = np.where(common, np.cumsum(common) - 1, -1)
    step = 2048
    for k in range(0, int(common.sum()), step):
        tables = []
        for n, row, column in ((shape[0], i, place[a]), (shape[1], j, place[b])):
            own = (column >= k) & (column < k + step)
            table = np.zeros((n, step), np.float32)
            table[row[own], column[own] - k] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    j, first = j[np.argsort(b, kind="stable")], np.cumsum(n_b) - n_b
    rare = (~common & (n_b > 0))[a]
    i, a = i[rare], a[rare]
    upto = np.cumsum(n_b[a])
    k = 0
    while k < len(a):
        done = upto[k - 1] if k else 0
        last = max(k + 1, int(np.searchsorted(upto, done + (1 << 21), "right")))
        n = n_b[a[k:last]]
        spot = np.repeat(first[a[k:last]] - (upto[k:last] - n - done), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(i[k:last], n) * shape[1] + j[spot], minlength=out.size).reshape(shape)
        k = last
    return out


def _met(table: pa.Table) -> pa.Table:
    """Of two blocks of a bucket (or one with itself): pairs of labels that links join, as a forest."""
    label, block = (table.column(c).combine_chunks().to_numpy() for c in ("label", "block"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    sets: list[np.ndarray] = []
    rows = np.flatnonzero(block == i), np.flatnonzero(block == j)
    merged: dict[str, list[int]] = {"a": [], "b": []}
    if len(rows[0]) and len(rows[1]) and len(np.unique(label)) > 1:
        for m, n, raw, off in chunks(table.column("text").combine_chunks()):
            found, row = shingles(words(raw, off))
            sets += [np.unique(found[row[k] : row[k + 1]]) for k in range(n - m)]
        left, right = ([sets[k] for k in side] for side in rows)
        both = _overlaps(left, right).astype(np.int64)
        total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
        link = (100 * both >= 75 * (total - both)) & (label[rows[0]][:, None] != label[rows[1]][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for k in np.flatnonzero(link.any(axis=1)):
            own = int(label[rows[0][k]])
            for other in np.unique(label[rows[1]][link[k]]).tolist():
                x, y = root(own), root(other)
                if x != y:
                    parent[x] = y
                    merged["a"].append(max(own, other))
                    merged["b"].append(min(own, other))
    return pa.table({c: pa.array(v, pa.int64()) for c, v in merged.items()})


def _components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``links`` (a, b): label is the smallest node reachable.

    Small-star and large-star steps in turn; each keeps the components and shortens paths, so
    that the number of rounds is logarithmic. Every step is one aggregation and one join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = edges.coalesce(max(1, now[0] // LINKS_A_TASK))
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of every document under Jaccard similarity of 0.75 on 5-word shingles.

    Texts of equal shingle sets form one class and are compared once. Candidates are first
    star edges: in each bucket the members meet two centres, those that share most buckets
    with others; small buckets meet in full. Then each larger bucket that still holds several
    components is dealt into blocks, and all its pairs of different components meet, block
    by block, on full sets; buckets of several bands with the same members do so once. So every pair that shares a bucket is tested or joined already.

    Null and wordless texts have n_shingles 0 and are their own component. Very long texts are
    compared whole, on all their shingles. Repeated rows get equal results (ties). component_id is the smallest doc_id of the component (null ids come last).
    Columns other than doc_id and text are not looked at. An empty table gives none.
    """
    ship(docs)
    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    base = cut(keyed.mapInArrow(_sketches, _SKETCH))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    classes = cut(base.where("class_id is not null").groupBy("class_id").agg(one.alias("one"), F.count("*").alias("n")).select("class_id", "one.doc_id", "one.text_key", "n"))
    # the join is on the row, not on the class alone, so that a text's many copies don't meet
    first = classes.select(F.col("class_id").alias("c_class"), F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"))
    nodes = cut(base.join(first, (F.col("class_id") == F.col("c_class")) & same(F.col("doc_id"), F.col("c_id")) & (F.col("text_key") == F.col("c_key"))).groupBy("class_id").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    rows = nodes.select("class_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    crowded = rows.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = cut(looked_up(rows, crowded.withColumn("rows", F.col("m")), ["band", "key"], "rows"))
    popular = buckets.groupBy("class_id").agg(F.sum("m").alias("popular"))
    sketches = nodes.select("class_id", "sketch")
    hot = buckets.select("class_id").distinct()
    texts = cut(keyed.join(nodes.join(hot, "class_id").select("class_id", F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")), same(F.col("doc_id"), F.col("c_id")) & (F.col("text_key") == F.col("c_key"))).groupBy("class_id").agg(F.first("text").alias("text")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sketches.select(F.col("class_id").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
        likely = cut(pairs.mapInArrow(_agreeing, "a long, b long"))
        for side in "ab":
            likely = likely.join(texts.select(F.col("class_id").alias(side), F.col("text").alias(f"text_{side}")), side)
        return cut(likely.mapInArrow(_links, "a long, b long"))

    # hubs: who shares most buckets with others is likest to most of them
    share = F.pmod(F.xxhash64("class_id"), F.lit(1000)) / 1000.0
    orders = [-F.col("popular").cast("double"), -F.col("popular") * (1 + SPREAD * share)]
    own = buckets.join(popular, "class_id").select("band", "key", "m", "class_id", "popular")
    member = lambda o: F.min(F.struct(o.alias("o"), F.col("class_id")))["class_id"]
    few = F.col("m") <= PAIRS_UP_TO
    centres = own.groupBy("band", "key", "m").agg(F.array(*map(member, orders)).alias("centres"), F.collect_set(F.when(few, F.col("class_id"))).alias("all"))
    # a large bucket's set is empty
    centres = centres.withColumn("all", F.when(few, F.col("all")))
    met = in_shares(own.select("band", "key", "m", "class_id"), centres, ["band", "key"], "m", ["class_id"]).select("class_id", F.explode(F.coalesce("all", "centres")).alias("c"))
    pairs = cut(met.where("c <> class_id").select(F.greatest("class_id", "c").alias("a"), F.least("class_id", "c").alias("b")).distinct())
    labels = cut(_components(confirmed(pairs)))

    # then every pair of different labels in a larger bucket, on full sets, block by block
    large = buckets.where(F.col("m") > PAIRS_UP_TO).join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("band", "key", "m", "class_id", "n_shingles", F.coalesce("label", "class_id").alias("label"))
    large = cut(large)
    # two sums of hashes tell whether buckets of several bands have the same members: one of them is enough
    prints = [F.sum(F.xxhash64("class_id", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in range(2)]
    each = large.groupBy("band", "key", "m", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), *prints)
    main = F.max(F.struct("n", "s", "label"))
    sizes = each.groupBy("band", "key", "m").agg(F.count("*").alias("labels"), main.alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where("labels > 1")
    sizes = sizes.groupBy("m", "h0", "h1").agg(F.min(F.struct("band", "key", "main", "n", "s")).alias("one")).select("m", "one.*")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    # members of the commonest label needn't meet each other
    sizes = sizes.select("band", "key", "m", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("of_main"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("of_rest"))
    dealt = in_shares(large, cut(sizes), ["band", "key"], "m", ["class_id"])
    is_main, salt = F.col("label") == F.col("main"), F.xxhash64("class_id")
    dealt = dealt.withColumn("block", F.when(is_main, F.pmod(salt, F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(salt, F.col("of_rest"))).cast("int"))
    partners = F.sequence(F.when(is_main, F.col("of_main")).otherwise(F.lit(0)), F.col("of_main") + F.col("of_rest") - 1)
    dealt = dealt.join(texts, "class_id").select("band", "key", "label", "block", "text", F.explode(partners).alias("partner"))
    dealt = dealt.select("band", "key", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "label", "block", "text")
    between = cut(dealt.groupBy("band", "key", "i", "j").applyInArrow(_met, "a long, b long"))
    if not between.isEmpty():
        moved = cut(_components(between)).withColumnsRenamed({"node": "old", "label": "new"})
        known = labels.select("node", "label").union(moved.select(F.col("old").alias("node"), F.col("old").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        labels = cut(known.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")))
    labelled = cut(classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", "doc_id", "n", F.coalesce("label", "class_id").alias("label")))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes"))
    of_class = looked_up(labelled, least, "label", "classes").select("class_id", "component_id", "n")
    out = looked_up(base.select("doc_id", "text_key", "n_shingles", "class_id"), of_class, "class_id", "n", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), same(F.col("doc_id"), component).alias("kept"))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
        near = (a == b).sum(axis=1) >= MIN_AGREE
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is their component's smallest, in the columns of documents, unchanged.

    Null and wordless texts stay. Rows equal in doc_id and text stay or go together, and so
    do different texts of one doc_id. Very long texts are compared whole. Other columns,
    whatever their names, are dropped. An empty table gives none.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(small(gone), same(F.col("doc_id"), F.col("gone_id")) & (text_key() == F.col("gone_key")), "left_anti")
