"""Connected components of a link table, by contraction; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.frames import staged


def _hooks(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, where that is smaller than itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("m")).filter("m < a").withColumnRenamed("a", "node")


def _jumped(hooks: DataFrame) -> DataFrame:
    """Every node's last node of its chain. Chains fall strictly, so they end."""
    while True:
        ends = hooks.select(F.col("node").alias("m"), F.col("m").alias("next"))
        jumped = hooks.join(ends, "m", "left").select("node", F.coalesce("next", "m").alias("m"), F.col("next").isNotNull().alias("moved"))
        jumped = staged(jumped, "jumped")
        hooks = jumped.select("node", "m")
        if jumped.filter("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component: its smallest node."""
    links = staged(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        hooks = _jumped(_hooks(links))
        if found is None:
            found = hooks.select("node", F.col("m").alias("component"))
        else:
            moved = hooks.select(F.col("node").alias("component"), "m")
            kept = found.join(moved, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
            found = kept.unionByName(hooks.select("node", F.col("m").alias("component")))
        found = staged(found.groupBy("node").agg(F.min("component").alias("component")), "components")
        ends = hooks.select(F.col("node").alias("a"), F.col("m").alias("ma"))
        links = links.join(ends, "a", "left").select(F.coalesce("ma", "a").alias("a"), "b")
        links = links.join(ends.toDF("b", "mb"), "b", "left").select("a", F.coalesce("mb", "b").alias("b"))
        links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = staged(links.distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots).distinct()
