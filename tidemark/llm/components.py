"""Connected components of links between ids, by rounds of large and small stars.

Nothing but two counts a round comes to the driver. Every round is written to the shared folder, so
lineage stays short and a lost executor costs a round at most. A star's centre is found by a partial
minimum, so a node with very many links is combined where its rows are.

Defined results: links to itself and repeated links count once; nulls are left out; no links, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_written, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node reaches; nodes without links are not in it."""
    links = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where(f"{a} != {b}").distinct()
    links = written(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # Large star: what is above a node goes to the smallest of its neighbours and itself.
        least = both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("least"))
        large = both.where("high > low").join(least, "low").select(F.col("least").alias("low"), "high").where("low != high").distinct()
        # Small star: a node and what is below it go to the smallest below it.
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(F.explode(F.array("low", "high")).alias("high"), F.col("least").alias("low")).where("low != high").distinct()
        new = written(small.select("low", "high"), "links")
        changed = new.exceptAll(links).limit(1).count() + links.exceptAll(new).limit(1).count()
        drop_written(links)
        links = new
        if not changed:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
