"""Connected components of a link table, distributed: alternating large and small stars.

Every step maps the links to new links with the same components; the fixed
point is a star around the smallest node of each component.  Links stay in
tables of the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its partners v.  The minimum is pre-aggregated and joined, so a hub isn't gathered."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` has two columns of one orderable type without nulls; self-links
    and repeated links are harmless.
    """
    a, b = links.columns
    edges = scratch.keep(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before, k = tuple(now), k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        small = _star(down)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = scratch.keep(small.where("u <> v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).groupBy("u").agg(F.min("v").alias("root")).select(
        F.col("u").alias("node"), "root"
    ).unionByName(edges.select(F.least("u", "v").alias("node")).distinct().withColumn("root", F.col("node")))
