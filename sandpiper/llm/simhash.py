"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from sandpiper.llm.graph import components, join_by
from sandpiper.llm.jaccard import BROADCAST_ROWS, grouped
from sandpiper.llm.tokens import binary, parcels
from sandpiper.session import cut, ship

BITS = 64
SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: bit set where over half the XXH64 hashes of its word shingles have it (no word: 0)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : min(at + SLICE, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        digests = np.frombuffer(b"".join(map(xxh64_digest, grams, repeat(seed))), np.uint8)
        votes += np.unpackbits(digests).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is a signed long. Null text counts as no words."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in parcels(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t, shingle) for t in binary(batch, "text")], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (node, fp) that keep every component whole.

    A ball of half the radius around each fingerprint is emitted; two fingerprints within the radius meet in a variant.
    All that meet in a variant are within the radius of each other, so each is linked to the smallest node there and no
    pairs are enumerated; a variant is met by as many as the ball has members at most, whatever the data.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = nodes.select("node", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("variant"))
    meet = Window.partitionBy("variant").orderBy("node")
    met = ball.select("node", "fp", F.first("node").over(meet).alias("a"), F.first("fp").over(meet).alias("a_fp"))
    return met.filter("node <> a").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("a_fp"))) <= radius).select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one node,
    so copies are never paired. Rows with a null doc_id link others as any row does; a component that has no other rows
    has a null component_id. Other columns are not read. A text is held whole by the task that reads it.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("__n")))
    near = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    linked = near.join(nodes, near.node == nodes.fp).select("fp", "component", "id", "__n")
    total = prints.count()
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("__n"))
    of = join_by(linked.select("fp", "component", F.col("__n").alias("rows")), "component", least, total).select("fp", "component_id", F.col("rows").alias("__n"))
    alone = nodes.join(near, nodes.fp == near.node, "left_anti").select("fp", F.col("id").alias("component_id"), "__n")
    out = join_by(prints, "fp", cut(of.unionByName(alone)), total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def neighbours(texts: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """(a, b): nodes (node, text) with fingerprints within the radius, by which all such nodes hang together.

    Nodes of one fingerprint are linked to the smallest of them, and those smallest by links().
    """
    prints = cut(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), shingle).select(F.col("doc_id").alias("node"), "fp"))
    tops = cut(prints.groupBy("fp").agg(F.min("node").alias("top"), F.count("*").alias("__n")))
    same = join_by(prints, "fp", tops, prints.count()).filter("node <> top").select(F.col("top").alias("a"), F.col("node").alias("b"))
    return same.unionByName(links(tops.select(F.col("top").alias("node"), "fp"), radius))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The documents with one row left of each group of similar ones: the row with the smallest doc_id, null ids last.

    Similar are texts whose sets of word shingles have a Jaccard similarity of ``similarity`` at least, and what such texts connect.
    SimHash finds them: fingerprints within the radius meet in the middle, and every meeting is verified on the whole sets. As similar
    texts may be further apart in their fingerprints, an exact join follows between the groups so found. Rows are told apart by their
    place in the input; where that isn't read from a table or checkpoint but made by a shuffle, it is checkpointed first, so
    that the places stay the same.
    """
    shuffled = "Exchange" in docs._jdf.queryExecution().executedPlan().toString()
    rows = (cut(docs) if shuffled else docs).withColumn("__row", F.monotonically_increasing_id())
    found = cut(grouped(rows.select(F.col("__row").alias("row"), "doc_id", "text"), lambda texts: neighbours(texts, shingle, radius), shingle, similarity))
    kept = cut(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("__n")).filter("__n > 1").select("component", F.col("first.row").alias("kept"), "__n"))
    gone = cut(join_by(found, "component", kept, found.count()).filter("row <> kept").select(F.col("row").alias("__gone")))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(few, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
