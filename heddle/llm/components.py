"""Connected components of a graph of links, in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node of a link reaches.

    Labels spread along links and jump along labels; each round is written, so a
    lost executor costs one round.  Nothing but the count of changes comes to the
    driver.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = settle(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct(), "links")
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("comp")).select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        heard = both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("comp").alias("heard"))
        spread = labels.join(heard, labels["node"] == heard["dst"], "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("heard", "comp")).alias("comp"))
        spread = settle(spread, "spread")
        far = spread.select(F.col("node").alias("_at"), F.col("comp").alias("_far"))
        jumped = spread.join(far, spread["comp"] == far["_at"], "left").select("node", "old", F.least("comp", F.coalesce("_far", "comp")).alias("comp"))
        jumped = settle(jumped, "labels")
        labels = jumped.select("node", "comp")
        if jumped.filter("old <> comp").isEmpty():
            return labels
