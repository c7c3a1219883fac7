"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.storage import staged


def components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) from links ``a``, ``b``.

    Every round lowers a node's label to the smallest of its neighbours' labels and then to the label of
    its label, until the sum of labels stands still. Each round is a written table, so a lost executor
    costs one round. Both sides of the joins are scans of written tables: a node with very many
    links is one row on one side and is split by the adaptive skew join on the other.
    NULLs and loops link nothing; an empty table gives an empty table.
    """
    forward = links.where("a <> b").select("a", "b").distinct()
    edges = staged(forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        target = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        lowered = edges.join(target, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = staged(
            labels.join(lowered, "node").select("node", F.least("label", "near").alias("label")), "labels"
        )
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = staged(hooked.join(jump, "label").select("node", F.col("further").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return labels.select("node", F.col("label").alias("component"))
