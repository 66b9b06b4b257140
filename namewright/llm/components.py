"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges(u, v), any comparable ids -> (node, component): the least node reachable.

    Nodes without an edge to another node are absent.  Self loops, repeated and reversed edges are
    allowed; rows with a null end are ignored.  Each round is written to the shared folder, so no
    lineage grows and nothing is gathered on the driver but a count and a checksum.
    """
    work = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    work = stored(work, label)
    before = _state(work)
    while before[0]:
        work = stored(_small_star(_large_star(work).distinct()).where("u <> v").distinct(), label)
        after = _state(work)
        if after == before:
            break
        before = after
    stars = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
