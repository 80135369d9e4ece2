"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, remove


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component``, the smallest vertex reachable, for every end of ``edges`` (src, dst).

    Each round points every vertex to its smallest neighbour, follows the
    pointers to their roots, and contracts the graph to the roots, which at
    least halves the vertices.  Edges lie in shared tables, never on the driver.
    """
    found = None
    current = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    while not current.isEmpty():
        both = current.union(current.select("dst", "src"))
        parent = materialize(
            both.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("root")),
            "parents",
        )
        while True:
            above = parent.select(F.col("src").alias("root"), F.col("root").alias("next"))
            jumped = parent.join(above, "root")
            if jumped.where("next <> root").isEmpty():
                break
            further = materialize(jumped.select("src", F.col("next").alias("root")), "parents")
            remove(parent)
            parent = further
        if found is None:
            found = parent.select(F.col("src").alias("vertex"), F.col("root").alias("component"))
        else:
            moved = parent.select(F.col("src").alias("component"), "root")
            found = found.join(moved, "component", "left").select(
                "vertex", F.coalesce("root", "component").alias("component")
            )
        ends = parent.select(F.col("src").alias("end"), F.col("root").alias("at"))
        contracted = (
            current.join(ends, current.src == ends.end)
            .select(F.col("at").alias("src"), "dst")
            .join(ends, F.col("dst") == ends.end)
            .select("src", F.col("at").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        smaller = materialize(contracted, "edges")
        remove(current)
        current = smaller
    remove(current)
    if found is None:
        return edges.sparkSession.createDataFrame([], "vertex bigint, component bigint")
    return found
