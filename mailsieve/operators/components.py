"""Connected components of an edge table, by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest node of its
neighbourhood; small-star does the same for the smaller neighbours.  Alternated
until the edge table no longer changes, every component is a star around its
smallest node.  There is no round limit: the loop ends only at the fixed point.

Scale: one row per edge and round, two shuffles per step.  The centre of a big
star is a hot key, so its edges are salted by the other end and the (narrow)
minimum of each node is replicated once per salt; the minimum itself is a
combinable aggregate.  Every step is checkpointed, so the lineage stays short
and a lost executor recomputes one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.session import checkpoint_dir

SALTS = 8


def _salt(col: str):
    return F.pmod(F.xxhash64(col), F.lit(SALTS))


def _with_minimum(sided: DataFrame) -> DataFrame:
    """(u, v) rows -> (u, v, m), m the smallest of u and all its v in ``sided``."""
    low = sided.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    spread = low.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return sided.withColumn("s", _salt("v")).join(spread, ["u", "s"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_minimum(both).where("v > u AND v <> m")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_minimum(edges)
    down = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = found.select("u", F.col("m").alias("v"))
    return down.unionByName(own).where("u > v").distinct().checkpoint()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                 .first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node on an edge between two different nodes; root = smallest node reachable.

    Null ends, self loops, repeated and reversed edges are allowed and carry no
    information.  An empty edge table gives an empty result.
    """
    checkpoint_dir(edges.sparkSession)
    e = (edges.where(F.col(src) != F.col(dst))
         .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
         .distinct().checkpoint())
    before = _state(e)
    while before[0]:
        e = _small_star(_large_star(e))
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
