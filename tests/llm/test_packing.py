import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sandpiper.llm.packing import pack, plan
from sandpiper.llm.queries import op6_packing

from .helpers import docs, odd_docs, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sound(rows, texts, capacity=1024):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    total = 0
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert len(own) == math.ceil(len(ids) / capacity) and all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for members in by_seq.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq), total / capacity


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, least = sound(op6_packing(spark, sf_dir).collect(), texts)
    assert used <= math.ceil(least) + 3


def least(counts, capacity):
    """A lower bound: pieces over capacity - t need a sequence each that takes nothing of t or more, for every t."""
    mass = counts * np.arange(capacity)
    half = capacity // 2 + 1
    best = 0
    for t in range(half):
        large = counts[capacity - t + 1 :].sum() if t else 0
        middle = max(counts[half : capacity - t + 1].sum(), math.ceil(mass[t : capacity - t + 1].sum() / capacity))
        best = max(best, large + middle)
    return best


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = random.Random(3)
    for capacity in (8, 64, 1024):
        counts = np.array([0, *(rng.randrange(5000) for _ in range(capacity - 1))])
        used, n = np.zeros(capacity, np.int64), 0
        steps = plan(counts, capacity)
        for members, times in steps:
            assert sum(a * k for a, k in members) <= capacity and times > 0
            n += times
            for a, k in members:
                used[a] += k * times
        assert (used == counts).all()
        assert n <= 1.015 * least(counts, capacity) + 1
        assert len(steps) <= 3 * capacity
    assert plan(np.zeros(5, np.int64), 5) == []


def test_odd_rows(spark):
    rows = odd_docs(spark)
    got = pack(with_clashes(rows).repartition(3), PATH, with_ids=True).collect()
    assert sum(r.doc_id == 4 for r in got) == 2 and {r.length for r in got if r.doc_id in (0, 1)} == {1}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and all(len(r.ids) == 4 * r.length for r in got)
    assert pack(docs(spark, []), PATH).count() == 0
