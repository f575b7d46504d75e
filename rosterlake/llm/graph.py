"""Connected components and the pairs of groups, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(entity, component) of every node of the edges; component is the least node reached.

    Labels go to neighbours and are shortened through the label's own label, so
    the number of rounds grows with the logarithm of the longest path. Each
    round is written out, which cuts the lineage, and a node's labels are
    reduced with partial minima, so a node with very many neighbours is no
    burden to one task.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = materialise(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("entity")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        theirs = both.join(labels.select(F.col("entity").alias("y"), "component"), "y").select(F.col("x").alias("entity"), "component")
        # what a label's own node is labelled with
        further = labels.select("entity", F.col("component").alias("mid")).join(labels.select(F.col("entity").alias("mid"), "component"), "mid").select("entity", "component")
        new = labels.unionByName(theirs).unionByName(further).groupBy("entity").agg(F.min("component").alias("component"))
        new = materialise(new, "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "entity").filter("component != old").limit(1).count()
        labels = new
        if not changed:
            return labels


#: Members of a group that one task pairs with the others; a larger group is cut into parts, each in a task of its own.
PART = 5_000


def pairs_within(members: DataFrame, group: str, item: str, some: DataFrame | None = None) -> DataFrame:
    """(x, y), x < y: every two different items of a group. Null items pair with nothing; repeated rows give repeated pairs.

    Given ``some`` of the members, x is one of these and y any other of its group, greater or not.

    The output is all pairs by its meaning, for callers whose columns are fixed
    so. One side of a large group is split by hash and the other one sent to
    each part, so no task gets a hot group whole.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1").select(group, F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    several = members.select(group, item).join(sizes, group)
    left = several if some is None else some.select(group, item).join(sizes, group)
    left = left.select(group, F.pmod(F.xxhash64(item), "parts").cast("int").alias("part"), F.col(item).alias("x"))
    right = several.select(group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(item).alias("y"))
    return left.join(right, [group, "part"]).filter("x < y" if some is None else "x != y").select("x", "y")
