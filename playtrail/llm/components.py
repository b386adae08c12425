"""Connected components of a list of links, by alternating large and small stars.

Every round links each node's larger neighbours, then its smaller ones, to the smallest node among
them; the rounds end when the links no longer change, after about the logarithm of the longest
chain. Each round is written to the cluster's folder for checkpoints, so lost executors cost one round
at most; how many links there are and what they hash to is observed while they are written. A round
that counts links of a repeated task twice only looks like a change and costs one more round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from playtrail.llm.common import workspace


def _large_star(links: DataFrame) -> DataFrame:
    """Links (u > v): every larger neighbour of a node to the smallest of the node's star."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links (u > v): every smaller neighbour of a node, and the node, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _stored(links: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """The links as written to `path`, and what tells them from others."""
    state = Observation()
    seen = F.count(F.lit(1)).alias("links"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")
    links.observe(state, *seen).write.parquet(path)
    return links.sparkSession.read.schema("u bigint, v bigint").parquet(path), state.get


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node it is linked with, for all nodes of `links` (two
    long columns, `a` and `b`) but the smallest ones themselves."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    path, number = workspace(links.sparkSession, "components"), 0
    before = None
    links, now = _stored(links.where("u > v").distinct(), f"{path}/0")
    while now["links"] and now != before:
        number, before = number + 1, now
        links, now = _stored(_small_star(_large_star(links)), f"{path}/{number}")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
