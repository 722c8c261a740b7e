"""Connected components of a graph that is only ever held in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewell.llm._shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) -> (node, comp): comp is the smallest node that links lead to, node itself included.

    Each round takes the least label among a node's neighbours and then the label's own label, so paths shorten about
    by half; every round is written to the shared folder. Loops and repeated edges are harmless; nodes without edges aren't returned.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = materialize(both)
    state = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while True:
        near = both.join(state, both["v"] == state["node"]).groupBy("u").agg(F.min("comp").alias("m"))
        new = state.join(near, state["node"] == near["u"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = state.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        new = materialize(new.join(up, F.col("comp") == F.col("_n")).select("node", "old", F.least("comp", "_c").alias("comp")))
        state = new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            return state
