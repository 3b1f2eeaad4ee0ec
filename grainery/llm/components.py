"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainery.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for every node of edges(a, b), self-loops aside.

    Labels spread to neighbours and then jump to their own label's label, so the
    number of rounds grows with the logarithm of the longest path. Only labels that are
    not their own label are looked up, so a component's final label, which all its nodes
    share, is no join key. Each round is a table in the shared folder, in place of the one before.
    """
    links = edges.select("a", "b").filter("a <> b")
    both = common.materialize(links.union(links.select("b", "a")).distinct(), "cc-edges")
    labels = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")).select("node", "label", F.lit(True).alias("moved")), "cc-labels")
    while labels.filter("moved").limit(1).count():
        far = labels.select(F.col("node").alias("b"), "label")
        near = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = common.materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-hooked")
        used = hooked.filter("label <> node").select("label").distinct()
        target = hooked.filter("label <> node").select("node", F.col("label").alias("next")).join(used.withColumnRenamed("label", "node"), "node", "left_semi")
        jumped = hooked.join(target.withColumnRenamed("node", "label"), "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        after = common.materialize(jumped.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "cc-labels")
        common.discard(labels, hooked)
        labels = after
    common.discard(both)
    return labels.select("node", "label")
