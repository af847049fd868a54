"""Connected components of links in a table, by alternating large and small stars.

Every round points the larger neighbours of a node at the smallest one it knows
of, then a node's smaller neighbours and itself at theirs; the number of rounds
grows with the logarithm of the longest path. Links stay in tables: the driver
sees a count and a checksum of each round. Every round is written to the shared
folder and read again, which cuts the lineage; the table before it is removed.

Nulls and edge cases: ``connected`` says them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasumi.llm.common import remove, shared_path


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component.

    Links with a null end and of a node with itself say nothing and are left out; repeated links count once; without links there are no rows.
    """
    spark, path = links.sparkSession, shared_path(links.sparkSession, "links")

    def kept(rows: DataFrame, number: int) -> DataFrame:
        rows.write.parquet(f"{path}/{number}")
        return spark.read.parquet(f"{path}/{number}")

    a, b = F.col(left), F.col(right)
    edges, number = kept(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), 0), 0
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pointed = large.join(least, "a")
        edges = kept(least.toDF("a", "b").union(pointed.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), number + 1)
        before, state = state, _state(edges)
        remove(spark, f"{path}/{number}")
        number += 1
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
