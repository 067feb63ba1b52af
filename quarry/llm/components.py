"""Connected components of a link table by alternating large and small stars.

Every round is two joins and partial aggregations over the links alone and is written to the
shared folder; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Component of every linked node: ``node``, ``component`` (the smallest node reachable).

    ``links``: long columns u and v. Nulls and self links are ignored; nodes without a link are not
    returned; an empty table gives an empty result.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    links = written(spark, links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        before = state
        links = written(spark, _small_star(_large_star(links)), "links")
    raise RuntimeError("components did not settle")
