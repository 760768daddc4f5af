"""Connected components by alternating large-star and small-star rounds.

Every round is a minimum per node (combined map-side) and one equi-join; its edges are written to the shared folder, so
lineage stays short. Star centres with very many neighbours only meet in joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialize


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sym.filter("v > u").join(_least(sym), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    m = _least(edges)
    hung = edges.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """[node, root] for every node of ``edges`` [u, v]; root is the smallest node reachable. Loops and nulls are ignored."""
    e = edges.filter("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
        e = materialize(_small_star(_large_star(e)))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
