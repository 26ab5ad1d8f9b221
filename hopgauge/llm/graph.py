"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgauge.llm.common import spent, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a long, b long); nodes without links are absent.

    Rounds of contraction: every node joins its smallest closed neighbour (by number and by a keyed hash in turn, so that stars
    and chains both shrink), then links between the joined nodes remain. Each round leaves written tables in the shared folder
    and costs a few shuffles of what remains; nothing is collected. Tables of earlier rounds are removed. Links to itself, repeated and null
    ones do no harm.
    """
    live = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, labels, turn = written(live, "links"), None, 0
    known = held = live
    while not live.isEmpty():

        def order(node: Column | str, turn: int = turn) -> Column:
            node = F.col(node) if isinstance(node, str) else node
            return F.struct((F.xxhash64(F.lit(turn), node) if turn % 2 else node).alias("key"), node.alias("node"))

        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joins = both.groupBy("a").agg(F.min(order("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", order("a"))["node"].alias("to"))
        joins = written(joins, "joins")
        to_a, to_b = joins.select(F.col("node").alias("a"), F.col("to").alias("ta")), joins.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        live = live.join(to_a, "a").join(to_b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        before, live = known, written(live, "links")
        known = live
        spent(before)
        if labels is None:
            labels, held = joins.withColumnRenamed("to", "label"), joins
        else:
            moved = joins.select(F.col("node").alias("label"), "to")
            labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            spent(held, joins)
            held = labels
        turn += 1
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
