"""Groups of texts whose sets of word shingles are similar: an exact join on the sets' prefixes."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.llm.graph import FEW_NODES, components, join_by
from sandpiper.llm.tokens import U, binary, mix, parcels, split_words, window_starts, windows
from sandpiper.session import cut, ship

#: Counters of shingles, and the parts they are summed in. Both only tune the order of prefixes.
SLOTS, PIECES = 1 << 17, 64
PER_PIECE = SLOTS // PIECES
#: Texts to be verified whose rows' numbers are broadcast at most (16 bytes each); with more, they are joined.
BROADCAST_ROWS = 2_000_000


class Sets:
    """The distinct shingles of several texts as 64-bit hashes: those of text d are key[first[d]] .. key[first[d + 1] - 1], in order.

    Letters A to Z count as small ones; a text of fewer words than a shingle has one shingle, a text without words none.
    """

    def __init__(self, texts: list[bytes], shingle: int):
        words = split_words([t.lower() for t in texts])
        h, n = words.hashes(), np.diff(words.first)
        at = np.flatnonzero(window_starts(words.first, shingle))
        few = np.flatnonzero((n > 0) & (n < shingle))
        short = np.array([windows(h[words.first[d] : words.first[d + 1]], int(n[d]))[0] + U(n[d]) for d in few], U)
        key = mix(np.concatenate([windows(h, shingle)[at] + U(shingle), short]))
        owner = np.concatenate([words.doc_of()[at], few])
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        self.key, self.owner = key[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def digest(self) -> np.ndarray:
        """A number for every set."""
        run = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.key ^ U(0xA5A5A5A5A5A5A5A5)))])
        return mix(run[self.first[1:]] - run[self.first[:-1]] + self.size.astype(U)).view(np.int64)


def slot(key: np.ndarray) -> np.ndarray:
    return (key & U(SLOTS - 1)).astype(np.int64)


def slot_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """For every slot how many texts' shingles fall into it, so that prefixes begin with rare ones."""

    def count(batches):
        table = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for part in parcels([batch]):
                table += np.bincount(slot(Sets(binary(part, "text"), shingle).key), minlength=SLOTS).astype(np.uint32)
        for piece, part in enumerate(table.reshape(PIECES, PER_PIECE)):
            have = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([have.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[have].tobytes()], pa.binary())], names=["piece", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PER_PIECE, np.uint32)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        return pa.table({"piece": table.column("piece")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "piece int, at binary, n binary").groupBy("piece").applyInArrow(add, "piece int, n binary").collect()
    out = np.zeros((PIECES, PER_PIECE), np.uint32)
    for r in rows:
        out[r.piece] = np.frombuffer(bytes(r.n), np.uint32)
    return out.reshape(-1)


def grouped(rows: DataFrame, near: Callable[[DataFrame], DataFrame], shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """row, doc_id, component for every row (row, doc_id, text): equal components reach each other by similar sets.

    Links come from ``near``: given (node, text), one text of each distinct set, it returns pairs (a, b), each of which is verified on the whole
    sets. An exact join then finds the similar pairs that lie between what those links connect, so none is missed whatever ``near`` leaves out.

    Two sets are similar if their Jaccard similarity is ``similarity`` at least. Equal sets (so also all texts without words) are
    one node. Two similar sets of which neither is small enough to be out of the question share a shingle among the first
    n - ceil(similarity * n) + 1 of each, in any order common to all; rare shingles come first, so that few others meet. Every
    meeting that size and place allow is verified on the whole sets, so no similar pair is missed and none is made up.

    Meetings outside the components known so far are first held against the smallest node only, for each shingle. What that leaves in
    one component needs no more; pairs are listed only between components that still meet, so a group of near copies isn't paired with itself.
    Texts are read again for each step and not shuffled; whole sets are sent only of texts that have a partner to be verified.
    """
    spark = ship(rows.sparkSession)
    part = Fraction(similarity).limit_denominator(1000)
    p, q = part.numerator, part.denominator

    def digests(batches):
        for batch in parcels(batches):
            s = Sets(binary(batch, "text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(s.digest()), pa.array(s.size.astype(np.int64))], names=["row", "doc_id", "node", "size"])

    prints = cut(rows.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(digests, "row long, doc_id long, node long, size long"))
    one = cut(prints.filter("size > 0").groupBy("node").agg(F.min("row").alias("one"), F.count("*").alias("__n")))

    def texts_of(chosen: DataFrame) -> DataFrame:
        """node, text for the chosen (node, one)."""
        few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
        return rows.select("row", "text").join(few, F.col("row") == F.col("one")).select("node", "text")

    firsts = texts_of(one.drop("__n"))

    def sets_of(batches):
        for batch in parcels(batches):
            s = Sets(binary(batch, "text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.key[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:], strict=True)], pa.binary())], names=["node", "keys"])

    def similar(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a_keys").to_pylist(), batch.column("b_keys").to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(a, U), np.frombuffer(b, U), assume_unique=True))
                good.append(both * (p + q) * 8 >= p * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""

        def whole(side: str) -> DataFrame:
            used = cut(pairs.select(F.col(side).alias("node")).distinct().join(one.drop("__n"), "node"))
            return texts_of(used).mapInArrow(sets_of, "node long, keys binary").select(F.col("node").alias(side), F.col("keys").alias(f"{side}_keys"))

        return cut(pairs.join(whole("a"), "a").join(whole("b"), "b").mapInArrow(similar, "a long, b long"))

    links = verified(cut(near(firsts)))
    known = components(links)

    common = spark.sparkContext.broadcast(slot_counts(firsts, shingle))

    def prefixes(batches):
        for batch in parcels(batches):
            s = Sets(binary(batch, "text"), shingle)
            order = np.lexsort((s.key, common.value[slot(s.key)], s.owner))
            length = s.size - (p * s.size + q - 1) // q + 1
            place = np.arange(len(order)) - np.repeat(s.first[:-1], s.size)
            have = place < np.repeat(length, s.size)
            node = np.repeat(batch.column("node").to_numpy(), length)
            yield pa.RecordBatch.from_arrays([pa.array(s.key[order][have].view(np.int64)), pa.array(node), pa.array(np.repeat(s.size.astype(np.int32), length)), pa.array(place[have].astype(np.int32))], names=["token", "node", "size", "place"])

    meet = Window.partitionBy("token")
    tokens = firsts.mapInArrow(prefixes, "token long, node long, size int, place int")
    met = tokens.withColumn("n", F.count("*").over(meet)).withColumn("lead", F.min(F.struct("node", "size", "place")).over(meet)).filter("n > 1")
    held = cut(met.select("token", "node", "size", "place", F.col("lead.node").alias("a"), F.col("lead.size").alias("a_size"), F.col("lead.place").alias("a_place")))

    may = f"{q} * least(a_size, size) >= {p} * greatest(a_size, size) AND {p + q} * least(a_size - a_place, size - place) >= {p} * (a_size + size)"
    label = F.broadcast(known) if known.count() <= FEW_NODES else known
    met_by = held.filter("a <> node").filter(may).select("a", F.col("node").alias("b")).distinct()
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of"))
    first = cut(met_by.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(a_of, a) <> coalesce(b_of, b)").select("a", "b"))
    links = cut(links.unionByName(verified(first)))
    label = components(links)
    told = held.join(label, "node", "left").select("token", "node", "size", "place", F.coalesce("component", "node").alias("component"))
    left = cut(told.withColumn("low", F.min("component").over(meet)).withColumn("high", F.max("component").over(meet)).filter("low < high").drop("low", "high"))
    other = left.select("token", *(F.col(c).alias(f"a_{c}") for c in ("size", "place", "component")), F.col("node").alias("a"))
    more = cut(other.join(left, "token").filter("a < node AND a_component <> component").filter(may).select("a", F.col("node").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    more = verified(more)
    if more.limit(1).count():
        label = components(links.unionByName(more))
    linked = cut(one.join(label, "node").select("node", "component", "__n"))
    few = join_by(prints, "node", linked, prints.count()).select("row", "doc_id", "component")
    return few.unionByName(prints.join(linked.select("node"), "node", "left_anti").select("row", "doc_id", F.col("node").alias("component")))
