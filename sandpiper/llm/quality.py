"""Quality rules: surface counts, and perplexity under modified Kneser-Ney models counted from the whole corpus.

Texts are dealt to two folds by a hash of their bytes, and each is scored by the model counted from the other fold, so that
neither its own n-grams nor those of its exact copies vouch for it. All documents are counted, whatever the other rules say.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from sandpiper.llm.tokens import U, binary, mix, parcels, split_words, window_starts, windows
from sandpiper.session import cut, ship

ORDER = 5
START, END = "\x02", "\x03"
SYMBOLS = "#*$%&|<>"
#: Entries of the sorted arrays that are broadcast at most (16 bytes each); larger ones are probed in parts.
MODEL_LIMIT = 4_000_000
#: Of the parts: entries of one at most, bytes of text in a block of documents, and blocks for each part at most.
PART_ROWS, BLOCK_BYTES, PROBING = 1_000_000, 16 << 20, 16
#: Languages whose bands are broadcast at most; with more, they are joined.
LANGS_LIMIT = 10_000
#: Rejected texts that are broadcast at most (some 30 bytes each); more are joined.
REJECTED_LIMIT = 1_000_000
#: They bound the memory of a task: text taken at a time, n-grams merged at a time, held, and sent at a time.
PARCEL_BYTES, MERGE_ROWS, GRAMS_HELD, EMIT_ROWS = 1 << 19, 200_000, 800_000, 50_000


# -- surface counts ---------------------------------------------------------


def surface(texts: list[bytes], repeat: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    words = split_words(texts)
    buf = words.buf
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]

    letters = ((buf & 0xC0) != 0x80) & (buf != 32) & ((buf < 9) | (buf > 13))
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in SYMBOLS]] = True
    at = np.flatnonzero(window_starts(words.first, repeat))
    own = words.doc_of()[at].astype(U)
    keys = mix(windows(words.hashes(), repeat)[at] + own * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    n = len(words.starts)
    cover = np.bincount(at[again], minlength=n + repeat + 1) - np.bincount(at[again] + repeat, minlength=n + repeat + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:n] > 0)])
    dup = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        lines = text.split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            full = [x for x in lines if x and not x.isspace()]
            dup[d] = len(full) - len(set(full))
    return {
        "n_words": np.diff(words.first), "word_chars": per_text(letters), "n_symbols": per_text(marks[buf]),
        "n_dup_lines": dup, "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
    }


def failed(has: dict, least_words: int = 20, most_repeat: int = 30):
    """The base rules, on arrays or on columns."""
    return (has["n_words"] < least_words) | (100 * has["n_repeat_words"] > most_repeat * has["n_words"])


# -- character n-grams ------------------------------------------------------


def text_hash(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def gram_keys(codes: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A 64-bit key for every run of ORDER code points; lang: the language's hash for each."""
    return mix(windows(codes.astype(U) + U(1), ORDER) + lang)


class Grams:
    """The n-grams of several texts, framed by start and end marks."""

    def __init__(self, texts: list[str], langs: list[str], hashes: dict[str, int]):
        self.codes = np.frombuffer("".join([START * (ORDER - 1) + t + END for t in texts]).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # n-grams of each text
        begin = np.cumsum(size + ORDER - 1) - (size + ORDER - 1)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.size = size
        self.at = np.arange(int(self.first[-1])) + np.repeat(begin - self.first[:-1], size)
        for lang in set(langs) - hashes.keys():
            hashes[lang] = text_hash(lang)
        by_text = np.array([hashes[x] for x in langs], U)
        every = windows(self.codes.astype(U) + U(1), ORDER)[self.at]
        self.keys = mix(every + np.repeat(by_text, size))


def lang_key() -> Column:
    return F.coalesce(F.col("lang"), F.lit("")).alias("lang")


def folds(texts: list[bytes]) -> np.ndarray:
    """0 or 1 for every text, by its bytes: exact copies are in one fold."""
    return np.fromiter((xxh64_intdigest(t) & 1 for t in texts), np.int64, len(texts))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c0, c1): every run of ORDER characters of a language's documents. c0: how often it occurs in texts outside
    fold 0, which is what texts in fold 0 are scored by; c1 likewise. Counts are summed in each task before they are shuffled."""
    ship(docs.sparkSession)

    def run(batches):
        hashes: dict[str, int] = {}
        names: list[str] = []
        index: dict[str, int] = {}
        held: list[tuple] = []  # (keys, counts, code points, languages), each with distinct keys

        def merged():
            # one column after the other, so that no second copy of all is made
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()
            keys = np.concatenate(columns.pop(0))
            order = np.argsort(keys)
            keys = keys[order]
            runs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.add.reduceat(np.concatenate(columns.pop(0))[order], runs)
            one = order[runs]
            return keys[runs], counts, np.concatenate(columns.pop(0))[one], np.concatenate(columns.pop(0))[one]

        def emit(_, counts, codes, owner):
            for at in range(0, len(counts), EMIT_ROWS):
                text = np.ascontiguousarray(codes[at : at + EMIT_ROWS]).tobytes().decode("utf-32-le")
                rows = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                c = [pa.array(counts[at : at + EMIT_ROWS, f].astype(np.int64)) for f in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in owner[at : at + EMIT_ROWS]]), pa.array(rows), *c], names=["lang", "gram", "c0", "c1"])

        for batch in parcels(batches, most_bytes=PARCEL_BYTES):
            raw, langs = binary(batch, "text"), batch.column("lang").to_pylist()
            g = Grams([t.decode() for t in raw], langs, hashes)
            for lang in langs:
                if lang not in index:
                    index[lang] = len(names)
                    names.append(lang)
            order = np.argsort(g.keys)
            ranked = g.keys[order]
            runs = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            where = order[runs]
            fold = folds(raw)
            outside = np.stack([fold == 1, fold == 0], axis=1).astype(np.int32)
            times = np.add.reduceat(np.repeat(outside, g.size, axis=0)[order], runs)
            of = np.repeat(np.array([index[x] for x in langs], np.int32), g.size)[where]
            held.append((ranked[runs], times, g.codes[g.at[where][:, None] + np.arange(ORDER)], of))
            if sum(len(h[0]) for h in held[1:]) > MERGE_ROWS:
                held.append(merged())
                if len(held[0][0]) > GRAMS_HELD:
                    yield from emit(*held.pop())
        if held:
            yield from emit(*merged())

    return docs.select(lang_key(), "text").mapInArrow(run, "lang string, gram string, c0 long, c1 long").groupBy("lang", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p0, p1): interpolated modified Kneser-Ney probability of the last character after those before it, by the
    counts c0 and c1.

    Counts of the highest order are as counted; a lower order counts the different characters before a run. Each order
    has its three discounts for each language from its counts of counts (Chen and Goodman 1998), within [0, count].
    A run with the count 0 gets what its context leaves for unseen ones; a context without counts leaves all.
    """
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", F.expr("substr(gram, 2)").alias("gram")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in ("c0", "c1")))
    below = None
    for k in range(1, order + 1):
        level = levels[k]
        context = Window.partitionBy("lang", F.expr(f"substr(gram, 1, {k - 1})")) if k > 1 else Window.partitionBy("lang")
        times, discounts, parts, here = [F.count("*").alias("kinds")], [], [], []
        for f in (0, 1):
            times += [F.count_if(F.col(f"c{f}") == i).cast("double").alias(f"n{f}{i}") for i in (1, 2, 3, 4)]
            y = f"coalesce(n{f}1 / nullif(n{f}1 + 2 * n{f}2, 0), 0.5)"
            discounts += [F.expr(f"least({i}D, greatest(0D, coalesce({i} - {i + 1} * {y} * n{f}{i + 1} / nullif(n{f}{i}, 0), {i} * 0.5D)))").alias(f"d{f}{i}") for i in (1, 2, 3)]
            parts += [F.sum(f"c{f}").over(context).alias(f"s{f}")] + [F.sum(F.when(F.expr(f"c{f} {test}"), 1).otherwise(0)).over(context).alias(f"m{f}{i}") for i, test in ((1, "= 1"), (2, "= 2"), (3, ">= 3"))]
            own = f"coalesce((c{f} - CASE WHEN c{f} = 0 THEN 0 WHEN c{f} = 1 THEN d{f}1 WHEN c{f} = 2 THEN d{f}2 ELSE d{f}3 END) / nullif(s{f}, 0), 0)"
            rest = f"coalesce((d{f}1 * m{f}1 + d{f}2 * m{f}2 + d{f}3 * m{f}3) / nullif(s{f}, 0), 1)"
            shorter = "1 / (kinds + 1)" if below is None else f"b_p{f}"
            here.append(F.expr(f"{own} + {rest} * {shorter}").alias(f"p{f}"))
        seen = level.groupBy("lang").agg(*times).select("lang", "kinds", *discounts)
        row = level.select("lang", "gram", "c0", "c1", *parts).join(seen, "lang")
        if below is not None:
            low = below.select(F.col("lang").alias("b_lang"), F.col("gram").alias("b_gram"), F.col("p0").alias("b_p0"), F.col("p1").alias("b_p1"))
            row = row.withColumn("end", F.expr("substr(gram, 2)")).join(low, (F.col("lang") == F.col("b_lang")) & (F.col("end") == F.col("b_gram")))
        below = row.select("lang", "gram", *here)
    return below


def packed_model(model: DataFrame) -> DataFrame:
    """(key, b0, b1): the model's keys with -log2 of both probabilities."""

    def run(batches):
        hashes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs) - hashes.keys():
                hashes[lang] = text_hash(lang)
            codes = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
            flat = np.ascontiguousarray(codes).reshape(-1)
            keys = mix(windows(flat.astype(U) + U(1), ORDER)[::ORDER] + np.array([hashes[x] for x in langs], U)) if len(langs) else np.zeros(0, U)
            bits = [pa.array(-np.log2(batch.column(p).to_numpy(zero_copy_only=False)).astype(np.float32)) for p in ("p0", "p1")]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *bits], names=["key", "b0", "b1"])

    return model.mapInArrow(run, "key long, b0 float, b1 float")


def sorted_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and the bits of both folds in turn for each."""
    keys = table.column("key").to_numpy().view(U)
    order = np.argsort(keys)
    return keys[order], np.stack([table.column(b).to_numpy() for b in ("b0", "b1")], axis=1)[order].reshape(-1)


# -- the operator -----------------------------------------------------------

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What tells texts apart: a verdict depends on the language and the text alone, so rows equal in these share it.
KEY = ("lang", "k1", "k2")
GIVEN = ("doc_id", *KEY)
SCORED = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("k1", LongType()), StructField("k2", LongType()), *(StructField(s, LongType()) for s in STATS), StructField("bits", DoubleType())])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null: ''), text, and two hashes of the text."""
    return docs.select(F.col("doc_id").cast("long"), lang_key(), "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("k"), "text").alias("k2"))


def scores(batch, keys: np.ndarray, bits: np.ndarray, hashes: dict[str, int]) -> pa.RecordBatch:
    """The rows of SCORED for documents whose n-grams are all among the keys."""
    raw = binary(batch, "text")
    found = surface(raw)
    g = Grams([t.decode() for t in raw], batch.column("lang").to_pylist(), hashes)
    unique, back = np.unique(g.keys, return_inverse=True)
    value = bits[2 * np.searchsorted(keys, unique)[back] + np.repeat(folds(raw), g.size)]
    total = np.add.reduceat(value.astype(np.float64), g.first[:-1]) if len(raw) else np.zeros(0)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in GIVEN), *(pa.array(found[s].astype(np.int64)) for s in STATS), pa.array(total / g.size)], names=SCORED.names)


def scored_in_parts(rows: DataFrame, packed: DataFrame, entries: int) -> DataFrame:
    """The rows of SCORED where the sorted arrays are too large for one machine.

    The arrays are cut into parts by ranges of the hash, the documents into blocks of some BLOCK_BYTES. A block sends its
    distinct keys to their parts, which look them up and send them back with their bits; the parts of a block's answer in
    order are a sorted array again. No part is copied, and there are as many as entries or blocks ask for, so what is sent grows
    with the text, and neither more text nor common n-grams make a task larger. Blocks are dealt by a hash of id and text.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_blocks = math.ceil((total + 1) / BLOCK_BYTES)
    n_parts = max(1, math.ceil(entries / PART_ROWS), math.ceil(n_blocks / PROBING))
    blocks = rows.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    part = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(n_parts), 32).cast("int")
    parts = packed.select(part.alias("part"), "key", "b0", "b1")

    def send(table: pa.Table) -> pa.Table:
        hashes: dict[str, int] = {}
        keys = np.zeros(0, U)
        for batch in parcels(table.to_batches(), most_bytes=PARCEL_BYTES):
            own = Grams([t.decode() for t in binary(batch, "text")], batch.column("lang").to_pylist(), hashes).keys
            keys = np.union1d(keys, own)
        at = ((keys >> U(32)) * U(n_parts)) >> U(32)
        edges = np.searchsorted(at, np.arange(n_parts + 1, dtype=U))
        have = np.flatnonzero(np.diff(edges))
        block = table.column("__block")[0].as_py()
        return pa.table({"part": pa.array(have.astype(np.int32)), "block": pa.array([block] * len(have), pa.int32()), "keys": pa.array([keys[edges[p] : edges[p + 1]].tobytes() for p in have], pa.binary())})

    def look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
        keys, bits = sorted_arrays(table)
        of = bits.reshape(-1, 2)
        found = [of[np.searchsorted(keys, np.frombuffer(k, U))].tobytes() for k in asked.column("keys").to_pylist()]
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "keys": asked.column("keys"), "bits": pa.array(found, pa.binary())})

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("part")
        keys, bits = (np.frombuffer(b"".join(known.column(c).to_pylist()), kind) for c, kind in (("keys", U), ("bits", np.float32)))
        hashes: dict[str, int] = {}
        return pa.Table.from_batches([scores(batch, keys, bits, hashes) for batch in parcels(table.to_batches(), most_bytes=PARCEL_BYTES)])

    asked = blocks.groupBy("__block").applyInArrow(send, "part int, block int, keys binary")
    known = asked.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(look_up, "block int, part int, keys binary, bits binary")
    return blocks.groupBy("__block").cogroup(known.groupBy("block")).applyInArrow(score, SCORED)


def scored(docs: DataFrame, model_limit: int = MODEL_LIMIT, held: list | None = None) -> DataFrame:
    """doc_id, KEY, the surface counts, and bits: the mean -log2 p of a document's characters and its end.

    The models have every n-gram of all documents of the language. Their bits are held in arrays sorted by 64-bit hashes of the
    n-grams: broadcast if there are at most model_limit of them, else in parts (see scored_in_parts). What is broadcast is added
    to ``held``, so that the caller can let go of it.
    """
    spark = ship(docs.sparkSession)
    packed = cut(packed_model(kneser_ney(cut(count_grams(docs)))))
    rows, entries = keyed(docs), packed.count()
    if entries > model_limit:
        return scored_in_parts(rows, packed, entries)
    table = spark.sparkContext.broadcast(sorted_arrays(packed.toArrow()))
    if held is not None:
        held.append(table)

    def direct(batches):
        hashes: dict[str, int] = {}
        for batch in parcels(batches, most_bytes=PARCEL_BYTES):
            yield scores(batch, *table.value, hashes)

    return rows.mapInArrow(direct, SCORED)


def verdicts(docs: DataFrame, least_words: int = 20, most_repeat: int = 30, below: float = 6.0, above: float = 8.0, least_spread: float = 0.35, model_limit: int = MODEL_LIMIT) -> DataFrame:
    """What judged() returns, with KEY."""
    base = failed({n: F.col(n) for n in STATS}, least_words, most_repeat)
    held: list = []
    rows = cut(scored(docs, model_limit, held).withColumn("bits", F.round("bits", 5)).withColumn("base_failed", base))
    for table in held:
        table.destroy()
    q = rows.filter("not base_failed").groupBy("lang", "bits").count().groupBy("lang").agg(F.percentile("bits", [0.25, 0.75], F.col("count")).alias("q"))
    margin = lambda times: F.greatest(F.lit(least_spread), times * (F.col("q")[1] - F.col("q")[0]))
    bands = cut(q.select(F.col("lang").alias("b_lang"), (F.col("q")[0] - margin(below)).alias("lower"), (F.col("q")[1] + margin(above)).alias("upper")))
    few = F.broadcast(bands) if bands.count() <= LANGS_LIMIT else bands
    out = rows.join(few, rows.lang == F.col("b_lang"), "left")
    kept = ~F.col("base_failed") & F.coalesce((F.col("bits") >= F.col("lower")) & (F.col("bits") <= F.col("upper")), F.lit(False))
    return out.select("doc_id", *KEY, *STATS, "base_failed", kept.alias("kept"), "bits", "lower", "upper")


def judged(docs: DataFrame, **rules) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, bits, lower, upper.

    base_failed: under least_words words, or over most_repeat percent of the words in repeated 8-word windows.
    kept: not base_failed, and the perplexity (2 ** bits for a character) is inside the language's band. By the character, as the model
    predicts characters: words that are long or joined don't count against a text.
    The band is set on bits, over the documents of the language that pass the base rules: from the first quartile to the
    third, widened by ``below`` and ``above`` interquartile ranges, and by least_spread bits at least (else a large group of
    copies would leave no width). Null text has no words and fails; a null language is a language of its own, and so is a
    rare one. One row for each input row; other columns are not read. A text is held whole by the task that reads it, with
    some 100 bytes for each of its characters. rules: see verdicts().
    """
    return verdicts(docs, **rules).drop(*KEY)


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows that judged() keeps, with their columns: each by its own language and text, whatever its doc_id or those of others.

    Nothing is joined by id: what is rejected is known by language and two hashes of the text, once each; it is broadcast up to
    REJECTED_LIMIT, else joined.
    """
    bad = cut(verdicts(docs, **rules).filter("not kept").select(*(F.col(c).alias(f"__{c}") for c in KEY)).distinct())
    few = F.broadcast(bad) if bad.count() <= REJECTED_LIMIT else bad
    own = {"lang": F.coalesce(F.col("lang"), F.lit("")), "k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("k"), "text")}
    same = functools.reduce(lambda a, b: a & b, (own[c] == F.col(f"__{c}") for c in KEY))
    return docs.join(few, same, "left_anti")
