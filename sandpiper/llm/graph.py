"""Connected components by label propagation with pointer jumping, and joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandpiper.session import cut

#: A key with more rows than this, and than this share of all, goes by broadcast: there are SHARE such keys at most.
HOT_ROWS, SHARE = 10_000, 10_000
#: Nodes whose labels are broadcast at most (16 bytes each).
FEW_NODES = 500_000


def join_by(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """rows with the columns of ``table``, which has one row for each key and its number of rows as __n.

    The rows of a hot key aren't shuffled: what the table says of it is broadcast. All others meet by a shuffle on the key.
    """
    hot = F.col("__n") > max(HOT_ROWS, total // SHARE)
    often, rarely = F.broadcast(table.filter(hot).drop("__n")), table.filter(~hot).drop("__n")
    spread = rows.join(often, key)
    return spread.unionByName(rows.join(often.select(key), key, "left_anti").join(rarely, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Every round takes the smallest label around each node, gives the smallest that any node of a label has met to all of them, and
    once more the smallest met by that one's; it ends when no label has met a smaller one. Labels and links stay distributed,
    only the number of changes comes to the driver; each round is checkpointed. Neither a node with many links nor a label with
    many nodes is gathered in one task: what is said of them is broadcast.
    """
    links = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")).select(F.col("a").alias("b"), F.least("a", "m").alias("component"), "__n"))
    total, few = links.count(), labels.count() <= FEW_NODES

    def meet(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table.drop("__n")), key) if few else join_by(rows, key, table, total)

    while True:
        near = meet(links, "b", labels).groupBy("a").agg(F.min("component").alias("near"))
        met = cut(labels.join(near, labels.b == near.a).select("b", F.col("component").alias("old"), "near", F.col("__n").alias("links")))
        least = cut(met.groupBy("old").agg(F.min("near").alias("one"), F.count("*").alias("__n")).withColumn("one", F.least("old", "one")))
        changed = least.filter("one <> old").limit(1).count()
        if not changed:
            return labels.select(F.col("b").alias("node"), "component")
        again = least.select(F.col("old").alias("one"), F.col("one").alias("two"))
        tops = least.join(F.broadcast(again) if few else again, "one", "left").select("old", F.coalesce("two", "one").alias("component"), "__n")
        labels = cut(meet(met, "old", tops).select("b", "component", F.col("links").alias("__n")))
