"""Substring dedup: repeated word windows, found by Rabin-Karp hashes, merge into removal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sandpiper.llm.chunks import Keys, answers, bucket_count, chunked, first_pass, next_pass
from sandpiper.llm.tokens import BUCKET_BASE, U, binary, mix, split_words, window_starts, windows


def _windows(texts: list[bytes], k: int, buckets: int):
    words = split_words(texts)
    h = words.hashes()
    at = np.flatnonzero(window_starts(words.first, k))
    keys = mix(windows(h, k)[at])
    bucket = (mix(windows(h, k, BUCKET_BASE)[at]) % U(buckets)).astype(np.int64)
    return words, at, Keys(keys, bucket, buckets)


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents without the words of any window that also starts earlier.

    A word goes if a window of ``window`` consecutive words covers it and the same words also start earlier (smaller
    doc_id, or same document and earlier start). Windows are judged on the input. All columns stay; text loses the
    words and the white space after them; three columns follow: n_words, n_removed and kept_words (the words left,
    joined by one space). A null text stays null and has no words. Documents shorter than a window are left alone.
    Null doc_ids come first. Rows that share a doc_id or have none are taken in the order of a hash of their text. A text is held
    whole by the task that reads it, with some 100 bytes for each of its words.

    Windows are counted by a 64-bit Rabin-Karp hash within buckets dealt by a second, independent hash; as buckets grow
    in number with the input, the chance that unequal windows meet does not.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_words")]
    marked, total = chunked(docs.select(*own))
    buckets = bucket_count(total, 6)

    def send(table: pa.Table, chunk: int) -> pa.Table:
        return _windows(binary(table, "text"), window, buckets)[2].packed(chunk)

    def cut(table: pa.Table, known: pa.Table, chunk: int) -> pa.Table:
        texts = binary(table, "text")
        words, at, keys = _windows(texts, window, buckets)
        again = np.ones(len(at), bool)
        again[keys.first] = keys.answered(known)
        n = len(words.starts)
        cover = np.bincount(at[again], minlength=n + window + 1) - np.bincount(at[again] + window, minlength=n + window + 1)
        gone = np.cumsum(cover)[:n] > 0
        n_words = np.diff(words.first)
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (n_words > 0) if len(texts) else n_words
        offset, cleaned, kept = 0, [], []
        for d, text in enumerate(texts):
            lo, hi = words.first[d], words.first[d + 1]
            if n_removed[d]:
                flags = gone[lo:hi]
                edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
                starts = words.starts[lo:hi] - offset
                ends = np.append(starts[1:], len(text))
                parts, done = [], 0
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    parts.append(text[done : starts[a]])
                    done = int(ends[b - 1])
                text_left = b"".join([*parts, text[done:]])
                cleaned.append(text_left)
                kept.append(b" ".join(text_left.split()))
            else:
                cleaned.append(text)
                kept.append(b" ".join(text.split()))
            offset += len(text) + 1
        nulls = table.column("text").is_null().to_pylist()
        out = {c: table.column(c) for c in own}
        out["text"] = pa.array([None if z else c for c, z in zip(cleaned, nulls, strict=True)], pa.binary()).cast(pa.string())
        return pa.table(out | {"n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept_words": pa.array(kept, pa.binary()).cast(pa.string())})

    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.select(*own).schema]
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_words", StringType())])
    return next_pass(marked, answers(first_pass(marked, send)), cut, schema)


def removal_digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    left = drop_repeats(docs.select("doc_id", "text"), window)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))
