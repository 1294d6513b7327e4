"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b) the smallest node that it reaches.

    Each round a node takes the smallest label among itself and its neighbours, then its label's label.
    Rounds are few: labels of labels halve the way that is left.  Each round is written to the shared
    folder; only the number of changed labels reaches the driver.  A node with very many neighbours
    costs nothing special: minima are combined before the shuffle and its rows in a join can be split.
    Edges with a null end are ignored; an empty table gives an empty result.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).filter("v is not null and u is not null and v <> u")
    both = store.stored(both.unionAll(both.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    labels = both.groupBy("v").agg(F.min("u").alias("l")).select("v", F.least("v", "l").alias("l"), F.lit(True).alias("moved"))
    labels = store.stored(labels, "labels")
    while labels.filter("moved").limit(1).count():
        near = both.join(labels.select(F.col("v").alias("u"), F.col("l").alias("near")), "u").groupBy("v").agg(F.min("near").alias("near"))
        stepped = labels.join(near, "v").select("v", F.col("l").alias("was"), F.least("l", "near").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("jump"))
        new = stepped.join(jump, "l").select("v", F.least("l", "jump").alias("l"), (F.least("l", "jump") < F.col("was")).alias("moved"))
        new = store.stored(new, "labels")
        store.dropped(labels)
        labels = new
    store.dropped(both)
    found = labels.select(F.col("v").alias("node"), F.col("l").alias("component"))
    found.stored_path = labels.stored_path
    return found
