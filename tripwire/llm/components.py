"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (``a``, ``b``): the smallest node of its component.

    Each turn a node takes the smallest label of itself and its neighbours,
    then its label's label; turns grow with the logarithm of a component's
    diameter, and each writes its small table to the shared folder.  No links
    give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = written(hooked.join(jump, "label").select("node", F.least("label", "further").alias("label"), "before"), "labels")
        changed = following.filter("label <> before").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels
