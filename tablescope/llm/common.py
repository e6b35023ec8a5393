"""What the operators of this subpackage share.

Rows that several steps read again are written once to the shared folder of the
session (`spark.checkpoint.dir`), which also cuts lineage: a lost executor costs a
re-read, never a recomputation from the start.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablescope.session import scratch_path

#: Rows that a side may have to be broadcast. Rows of such sides are a few numbers wide.
BROADCAST_ROWS = 500_000
#: Whether shuffle files go as the query that wrote them ends. Without it (Spark before 4.1
#: does not know it) they stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders by what `materialise` gave.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def share_code(spark: SparkSession) -> None:
    """Tell Python workers where this package lies. It serves while driver and executors
    see the package at the same path; elsewhere ship it with `--py-files`."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back. Its shuffle files go as it is
    written, unless the session says that they stay."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _folders[made] = path
    return made


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    if spark.conf.get(DROP_SHUFFLES, None) is not None:
        yield
        return
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES)


def discard(*made: DataFrame) -> None:
    """Delete the folders of DataFrames that `materialise` gave and nothing reads any more."""
    for df in made:
        path = _folders.pop(df, None)
        if path:
            spark = df.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (narrow, already materialised) marked for broadcast if it has at most `limit` rows.

    Beyond that it is returned as it is and joins by a shuffle, whose hot keys adaptive
    execution splits.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def star_round(now: DataFrame, label: str) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b. The edges it
    gives connect the same nodes, by shorter ways to the least of them; there are no more
    of them, and an edge may repeat, in both."""
    least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    # a node's edge to its least neighbour stays, its other neighbours are tied to that one
    up = Window.partitionBy("a").orderBy("b")
    small = large.select("a", "b", F.first("b").over(up).alias("m"), F.lag("b").over(up).alias("before"))
    return materialise(small.filter("before IS NULL OR before <> b").select(
        F.when(F.col("before").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.col("m").alias("b")), label)


def shortened(edges: DataFrame, label: str) -> DataFrame:
    """`edges` (a, b: long) after one round: not yet the roots, but fewer steps from them."""
    return star_round(_ordered(edges), label)


def _all_stars(now: DataFrame) -> bool:
    """Whether every node of the edges (a, b), a > b, that has a smaller neighbour has no
    other."""
    both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return not ends.filter("low < a AND low <> high").limit(1).count()


def connected(edges: DataFrame, label: str) -> DataFrame:
    """Union-find over `edges` (a, b: long): rows (node, root), roots left out.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components
    in MapReduce and Beyond") until every component is a star about its least node. Every
    round is joins and minima, with its edges written to the shared folder; the driver
    sees a count of at most one.
    """
    now = shortened(edges, label)
    while not _all_stars(now):
        now = star_round(now, label)
    return materialise(now.distinct(), label).select(F.col("a").alias("node"), F.col("b").alias("root"))
