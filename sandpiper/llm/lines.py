"""Line dedup: exact copies, then lines within one word of an earlier line, by a deletion-neighbourhood join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sandpiper.llm.chunks import Keys, answers, bucket_count, chunked, first_pass, next_pass
from sandpiper.llm.tokens import BUCKET_BASE, U, WINDOW_BASE, Words, binary, mix, powers, split_words

#: Shortest line, in words, that a word may be deleted from: one edit in five leaves a similarity of 0.8.
LEAST_WORDS = 5
WHOLE = -1


class Lines:
    """The lines with a word of several texts: line k has the words word[k] .. word[k + 1] - 1 of ``words``."""

    def __init__(self, texts: list[bytes]):
        self.words: Words = split_words(texts)
        breaks = np.flatnonzero(self.words.buf == 10)
        self.line_of = np.searchsorted(breaks, self.words.starts)  # every text ends with a break
        new = np.flatnonzero(np.diff(self.line_of, prepend=-1))
        self.word = np.append(new, len(self.line_of))
        self.number = self.line_of[new]  # counted over all lines of the chunk
        self.size = np.diff(self.word)
        self.hash = self.words.hashes()
        self.place = np.arange(len(self.hash)) - np.repeat(self.word[:-1], self.size)

    def sums(self, base: int) -> tuple[np.ndarray, np.ndarray, U]:
        """Polynomial sums before and from every word on, within its line."""
        longest = int(self.size.max()) + 1 if len(self.size) else 1
        run = np.concatenate([np.zeros(1, U), np.cumsum(self.hash * powers(base, longest)[self.place])])
        return run, np.repeat(run[self.word[1:]], self.size), U(pow(base, -1, 1 << 64))

    def whole(self, base: int = WINDOW_BASE) -> np.ndarray:
        """A key for every line's words."""
        run, _, _ = self.sums(base)
        return mix(run[self.word[1:]] - run[self.word[:-1]] + self.size.astype(U) * U(base))

    def without(self, base: int = WINDOW_BASE) -> np.ndarray:
        """For every word the key of its line without it."""
        run, total, inverse = self.sums(base)
        begin = np.repeat(run[self.word[:-1]], self.size)
        at = np.arange(len(self.hash))
        rest = (run[at] - begin) + (total - run[at + 1]) * inverse
        return mix(rest + (np.repeat(self.size, self.size) - 1).astype(U) * U(base))


def _dealt(keys: np.ndarray, other: np.ndarray, buckets: int) -> Keys:
    return Keys(keys, (other % U(buckets)).astype(np.int64), buckets)


def _exact(lines: Lines, buckets: int) -> Keys:
    return _dealt(lines.whole(), lines.whole(BUCKET_BASE), buckets)


def _kinds(known: pa.Table, kind: int) -> pa.Table:
    return known.filter(pa.array(known.column("kind").to_numpy() == kind))


def _distinct(lines: Lines, known: pa.Table, buckets: int) -> np.ndarray:
    """For every line: whether it is the corpus's first with its words."""
    keys = _exact(lines, buckets)
    first = np.zeros(len(lines.size), bool)
    first[keys.first] = ~keys.answered(known)
    return first


class Variants:
    """The deletion neighbourhood of the lines that are the first with their words: themselves and each with a word less."""

    def __init__(self, lines: Lines, first: np.ndarray, buckets: int):
        own = np.flatnonzero(first)
        cut = np.flatnonzero(np.repeat(first & (lines.size >= LEAST_WORDS), lines.size))
        owner = np.repeat(np.arange(len(lines.size)), lines.size)
        self.line = np.concatenate([own, owner[cut]])
        self.place = np.concatenate([np.full(len(own), WHOLE), lines.place[cut]])
        self.key = np.concatenate([lines.whole()[own], lines.without()[cut]])
        self.other = np.concatenate([lines.whole(BUCKET_BASE)[own], lines.without(BUCKET_BASE)[cut]])
        # 32 bits are sent, below the bucket: variants are one key only within a bucket, else the second would not be sent
        # to its own. A false meeting is found out in the next pass.
        bucket = self.other % U(buckets)
        self.keys = Keys((bucket << U(32)) | (self.key >> U(32)), bucket.astype(np.int64), buckets)

    def met(self, known: pa.Table) -> np.ndarray:
        """Variants that another line has too, here or elsewhere."""
        runs = self.keys.run
        low, high = np.full(len(self.keys.unique), 1 << 62), np.full(len(self.keys.unique), -1)
        np.minimum.at(low, runs, self.line)
        np.maximum.at(high, runs, self.line)
        return (self.keys.answered(known) | (low != high))[runs]


CANDIDATE = np.dtype([("key", "<u8"), ("other", "<u8"), ("place", "<i4"), ("line", "<i4")])
DEALT = "bucket int, chunk int, gone boolean, data binary"


def _dealt_candidates(lines: Lines, first: np.ndarray, v: Variants, met: np.ndarray, buckets: int, chunk: int) -> pa.Table:
    """The variants that other lines have too, by bucket, and the numbers of lines that the chunk itself shows to be copies.

    Of the chunk's lines with one variant at one place only the first is sent, the others are known to go. So a chunk sends
    a variant once for each place, however many lines have it.
    """
    hit = np.flatnonzero(met)
    order = hit[np.lexsort((v.line[hit], v.place[hit], v.other[hit], v.key[hit]))]
    rows = np.empty(len(order), CANDIDATE)
    rows["key"], rows["other"], rows["place"], rows["line"] = v.key[order], v.other[order], v.place[order], lines.number[v.line[order]]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["other"][1:] == rows["other"][:-1]) & (rows["place"][1:] == rows["place"][:-1])
    gone = np.unique(np.concatenate([lines.number[~first], rows["line"][again]])).astype("<i4")
    rows = rows[~again]
    at = (rows["other"] % U(buckets)).astype(np.int64)
    by_bucket = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[by_bucket], np.arange(buckets + 1))
    have = np.flatnonzero(np.diff(edges))
    data = [rows[by_bucket[edges[b] : edges[b + 1]]].tobytes() for b in have]
    bucket = [*have.tolist(), *([chunk % buckets] if len(gone) else [])]
    data += [gone.tobytes()] if len(gone) else []
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk] * len(bucket), pa.int32()), "gone": pa.array([k >= len(have) for k in range(len(bucket))], pa.bool_()), "data": pa.array(data, pa.binary())})


def _later(rows: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which candidates have an earlier line within one edit: both are the key with the same word put in, or one is the key."""
    place = rows["place"]
    line = (chunk.astype(np.int64) << 32) + rows["line"]
    order = np.lexsort((line, place, rows["other"], rows["key"]))
    key, other, place, line = rows["key"][order], rows["other"][order], place[order], line[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    never = np.iinfo(np.int64).max
    whole, cut_ = (np.minimum.reduceat(np.where(is_, line, never), starts)[of] for is_ in (place == WHOLE, place != WHOLE))
    later = np.where(place == WHOLE, cut_ < line, whole < line)
    later[1:] |= ~new[1:] & (place[1:] == place[:-1]) & (place[1:] != WHOLE)
    out = np.empty(len(order), bool)
    out[order] = later
    return out


def _verdicts(table: pa.Table) -> pa.Table:
    """Of one bucket: the lines of each chunk that go."""
    chunk = table.column("chunk").to_numpy()
    known = np.array(table.column("gone").to_pylist(), bool)
    blobs = table.column("data").to_pylist()
    parts = [np.frombuffer(blobs[i], CANDIDATE) for i in np.flatnonzero(~known)]
    out = [(int(chunk[i]), blobs[i]) for i in np.flatnonzero(known)]
    if parts:
        rows, of = np.concatenate(parts), np.repeat(chunk[~known], [len(p) for p in parts])
        later = np.flatnonzero(_later(rows, of))
        later = later[np.argsort(of[later], kind="stable")]
        which, edges = np.unique(of[later], return_index=True)
        out += [(int(c), np.unique(rows["line"][k]).tobytes()) for c, k in zip(which, np.split(later, edges[1:]), strict=True)] if len(which) else []
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "numbers": pa.array([n for _, n in out], pa.binary())})


def line_flags(marked: DataFrame, total: int) -> DataFrame:
    """(chunk, numbers): the lines to be removed, numbered within their chunk, as arrays of 32-bit numbers.

    The passes hang on one another within one job, so the text is shuffled once and read from that exchange by each.
    """
    exact_buckets, near_buckets, met_buckets = bucket_count(total, 300), bucket_count(total, 7), bucket_count(total, 40)

    def send_lines(table: pa.Table, chunk: int) -> pa.Table:
        return _exact(Lines(binary(table, "text")), exact_buckets).packed(chunk)

    exact = answers(first_pass(marked, send_lines))

    def send_variants(table: pa.Table, known: pa.Table, chunk: int) -> pa.Table:
        lines = Lines(binary(table, "text"))
        return Variants(lines, _distinct(lines, known, exact_buckets), near_buckets).keys.packed(chunk, np.uint32)

    near = answers(next_pass(marked, exact, send_variants, "bucket int, chunk int, keys binary"), np.uint32, earlier=False)
    known = exact.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))

    def candidates(table: pa.Table, known: pa.Table, chunk: int) -> pa.Table:
        lines = Lines(binary(table, "text"))
        first = _distinct(lines, _kinds(known, 0), exact_buckets)
        v = Variants(lines, first, near_buckets)
        return _dealt_candidates(lines, first, v, v.met(_kinds(known, 1)), met_buckets, chunk)

    return next_pass(marked, known, candidates, DEALT).groupBy("bucket").applyInArrow(_verdicts, "chunk int, numbers binary")


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that an earlier line equals or all but equals.

    Lines are parts of the text between line feeds; those without a word stay. A line goes if an earlier one (smaller
    doc_id, or same document and earlier place) is within one edit: it has the same words, or one word replaced,
    inserted or deleted, where the longer of both has LEAST_WORDS words at least. Lines are judged on the input, so
    of a chain of such lines the first stays. Every line emits its words without each of them in turn as a hashed key; lines
    that share a key are within one edit if the same word was deleted or one of them is the key itself, and this is verified
    with both 64-bit hashes and the place. No pairs are listed: each line is held against the first of its key, and a chunk
    sends a key once for each place.

    All columns stay; text is what is left, and n_lines and n_dropped follow. A null text stays null. Null doc_ids come
    first; rows that share a doc_id or have none are taken in the order of a hash of their text. A text is held whole by the
    task that reads it, with some 300 bytes for each of its words.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marked, total = chunked(docs.select(*own))

    def drop(table: pa.Table, known: pa.Table, chunk: int) -> pa.Table:
        gone = set(np.frombuffer(b"".join(known.column("numbers").to_pylist()), "<i4").tolist())
        texts = binary(table, "text")
        left, n_lines, n_dropped, at = [], [], [], 0
        for text in texts:
            lines = text.split(b"\n")
            kept = [x for k, x in enumerate(lines, at) if k not in gone]
            at += len(lines)
            left.append(b"\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        nulls = table.column("text").is_null().to_pylist()
        out = {c: table.column(c) for c in own}
        out["text"] = pa.array([None if z else x for x, z in zip(left, nulls, strict=True)], pa.binary()).cast(pa.string())
        return pa.table(out | {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.select(*own).schema]
    return next_pass(marked, line_flags(marked, total), drop, StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))
