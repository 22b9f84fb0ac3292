"""Connected components of a link table, by least labels and pointer jumping; every round is written to
the shared folder, and only a count of changes comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds between two writes.
ROUNDS = 2
#: Small link tables are written by so many tasks, larger ones by one for each FILE_BYTES of the links, if they have more
#: than that. Else each partition of a shuffle gets a file of a few rows in each round.
TASKS, FILE_BYTES = 8, 4 << 20


def _tasks(*tables: DataFrame) -> int:
    """Of tables that were written: how many tasks may write what comes from them."""
    stored = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    return max(TASKS, -(-stored // FILE_BYTES))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, comp): the least node that each linked node reaches. No links: no rows.

    A round takes the least label of all neighbours and then the label of that label, so a path of n
    nodes needs about log n rounds. Sums over neighbours are partial before any shuffle."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = materialize(both, "edges")
    tasks = _tasks(edges)
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp").coalesce(tasks), "labels")
    while True:
        step = labels.withColumn("old", F.col("comp"))
        for _ in range(ROUNDS):
            near = edges.join(step.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
            step = step.join(near, "node").select("node", "old", F.least("comp", "least").alias("comp"))
            # The further key makes Spark exchange both sides, so that it can split a component with very many nodes.
            jump = step.select(F.col("node").alias("comp"), F.xxhash64("node").alias("c2"), F.col("comp").alias("next"))
            step = step.withColumn("c2", F.xxhash64("comp")).join(jump, ["comp", "c2"]).select("node", "old", F.least("comp", "next").alias("comp"))
        step = materialize(step.coalesce(tasks), "labels")
        labels = step.select("node", "comp")
        if not step.where("old <> comp").limit(1).count():
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after more links: components of the components that these join, which are far fewer."""
    ca, cb = comps.withColumnsRenamed({"node": "a", "comp": "ca"}), comps.withColumnsRenamed({"node": "b", "comp": "cb"})
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("least"))
    old = comps.withColumn("c2", F.xxhash64("comp")).join(top.withColumn("c2", F.xxhash64("comp")), ["comp", "c2"], "left").select("node", F.coalesce("least", "comp").alias("comp"))
    new = top.select(F.col("comp").alias("node"), F.col("least").alias("comp")).join(comps.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new).coalesce(_tasks(comps, links)), "labels")
