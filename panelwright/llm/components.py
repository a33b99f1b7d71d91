"""Connected components of a link table, by alternating large-star and small-star steps.

Rounds are written to the shared folder, so no round depends on an executor that may be lost. So are the least neighbours
of a step, before edges are joined with them: the join has a plain exchange on each side, and the edges of a hub can be split.
Nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = _both_ways(edges)
    least = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "components-least")
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = stored(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), "components-down")
    least = stored(down.groupBy("src").agg(F.min("dst").alias("m")), "components-least")
    ties = down.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return ties.unionByName(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id reachable. Only nodes with a link have rows."""
    now = stored(edges.select("src", "dst").filter("src <> dst").distinct(), "components")
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        following = stored(_small_star(_large_star(now)), "components")
        after = _state(following)
        now, same, state = following, after == state, after
        if same:
            break
    else:
        raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
    roots = now.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64(F.lit(1), "src", "dst"))).first()
    return tuple(row)
