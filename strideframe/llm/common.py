"""What several corpus operators share: keys of rows, cut lineage, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows up to which a side is broadcast; a row here is a few numbers or one short string.
BROADCAST_ROWS = 200_000
#: Rows of one key from which it is looked up apart from the others.
HOT_ROWS = 10_000
#: Partitions of one shuffle at most: beyond so many groups or ranges, a task has several, one after another.
PARTITIONS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; rows equal in both are one document."""
    return F.xxhash64(F.col(text))


def _shared_dir(df: DataFrame) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set and there is a single process (local tests) a temporary folder is
    taken; on a cluster a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, materialised in the shared folder, so that lost executors cost no rerun."""
    _shared_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table there: for many narrow rows, which then take far less disk."""
    path = f"{_shared_dir(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df``, materialised, with a broadcast hint only if its counted rows allow that.

    ``weight`` counts rows that hold lists: as how many short ones each goes. Beyond
    BROADCAST_ROWS the hint is left out and the join shuffles both sides.
    """
    kept = cut(df)
    size = kept.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(kept) if size <= BROADCAST_ROWS else kept


def in_shares(rows: DataFrame, values: DataFrame, key: list[str], n: str, salt: list[str]) -> DataFrame:
    """``rows`` joined with ``values`` by shuffling both, the rows of a frequent ``key`` in many tasks.

    Both sides hold in ``n`` how many rows have the key (or 1, where that is few). A key of
    more than HOT_ROWS rows is dealt into shares of about so many by a hash of ``salt``, which
    should tell rows apart; its values are repeated for each share. ``n`` is dropped. Null keys
    meet nothing, and an empty side gives none.
    """
    shares = F.ceil(F.col(n) / HOT_ROWS).cast("int")
    left = rows.withColumn("_share", F.pmod(F.xxhash64(*salt), shares).cast("int")).drop(n)
    right = values.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop(n)
    return left.join(right, [*key, "_share"]).drop("_share")


def frequent(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, n) of the most frequent keys of ``counts``, which has a row for each: at most BROADCAST_ROWS, each of more than HOT_ROWS rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(HOT_ROWS, total // max(1, BROADCAST_ROWS))).select(key, n)


def looked_up(rows: DataFrame, values: DataFrame, key: str | list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which has a row for each ``key`` and in ``n`` how many rows have it.

    Beyond BROADCAST_ROWS values the join shuffles, but not for keys of very many rows: these
    go by broadcast, so that none of them meets in one task. However large the table, at most
    BROADCAST_ROWS keys can have more than one in BROADCAST_ROWS of the rows each. ``rows`` is
    read more than once, so it should be materialised. ``n`` is dropped. ``how`` may be left.
    """
    kept = cut(values)
    keys, total = kept.agg(F.count("*"), F.sum(n)).first()
    if keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(kept.drop(n)), key, how)
    least = max(HOT_ROWS, total // BROADCAST_ROWS)
    hot = kept.where(F.col(n) > least).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(kept.where(F.col(n) <= least).drop(n), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    name = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}.zip"
    with zipfile.ZipFile(name, "w") as out:
        for f in package.rglob("*.py"):
            out.write(f, f.relative_to(package.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)
