"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, tallied


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links(a, b)``; comp is its least node.

    Least labels move along the links and along the labels themselves (pointer
    jumping), so a chain of n links takes about log n rounds.  Every round is
    written to shared storage.
    """
    both = durable(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u <> v").distinct()
    )
    label = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")))
    while True:
        near = (
            both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("comp").alias("least"))
        )
        told = label.join(near, label["node"] == near["u"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp")
        )
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        step = told.join(up, "comp", "left").select("node", "old", F.least("comp", "top").alias("comp"))
        moved, changes = tallied(step, F.count_if(F.col("comp") != F.col("old")))
        label = moved.select("node", "comp")
        if not changes:
            return label


def widened(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp(node, comp)`` after the further ``links(a, b)``.

    Only the components that the links touch are nodes of the new rounds.
    """
    of = comp.select("node", "comp")
    ends = links
    for end in ("a", "b"):
        ends = ends.join(of.withColumnsRenamed({"node": end, "comp": f"of_{end}"}), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    more = components(durable(ends.select("a", "b").where("a <> b").distinct()))
    moved = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    told = of.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return durable(told.unionByName(more.join(of, "node", "left_anti").select("node", "comp")))
