"""Connected components of an edge list by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``id`` -> ``root`` (least id of its component) for every end of ``edges`` (``a``, ``b``: long).

    Each round hooks every label to its least neighbour and follows the hooks
    to their ends, then contracts the edges; edges shrink by a factor a round
    and no vertex's neighbours are ever gathered.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .where("a < b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id"))
    while not edges.isEmpty():
        hooks = saved(edges.groupBy("b").agg(F.min("a").alias("a")), "hooks")
        while True:
            nxt = hooks.alias("h").join(hooks.select(F.col("b").alias("mid"), F.col("a").alias("far")),
                                        F.col("h.a") == F.col("mid"), "left")
            moved = saved(nxt.select("h.b", F.coalesce("far", "h.a").alias("a"), F.col("far").isNotNull().alias("moved")),
                          "hooks")
            hooks = moved.select("b", "a")
            if moved.where("moved").isEmpty():
                break
        labels = saved(labels.join(hooks, labels["root"] == hooks["b"], "left")
                       .select("id", F.coalesce("a", "root").alias("root")), "labels")
        ends = edges
        for side in ("a", "b"):
            step = hooks.select(F.col("b").alias("from_"), F.col("a").alias("to_"))
            ends = ends.join(step, ends[side] == step["from_"], "left").withColumn(
                side, F.coalesce("to_", side)).select("a", "b")
        edges = saved(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .where("a < b").distinct(), "edges")
    return labels
