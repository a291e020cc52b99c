import random

import numpy as np

from sandpiper.llm import chunks
from sandpiper.llm.lines import LEAST_WORDS, Lines, Variants, drop_lines
from sandpiper.llm.queries import op7_line_dedup

from .helpers import docs, odd_docs, with_clashes


def close(a, b):
    """Within one word, by the definition of edit distance."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < LEAST_WORDS:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_all(rows):
    """Every line against all earlier lines of the input, dropped or not."""
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = line.encode().split()
            if not words or not any(close(words, w) for w in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[i] = "\n".join(kept)
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    want = brute_all(enumerate(texts))
    for size in (200, 1_500_000):
        monkeypatch.setattr(chunks.chunked, "__defaults__", (size,))
        got = {r.doc_id: r.text for r in drop_lines(docs(spark, texts).repartition(3)).collect()}
        assert got == want


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op7_line_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == brute_all(rows)
    assert sum(r.n_dropped for r in got) > 0


def test_odd_rows(spark):
    got = drop_lines(with_clashes(odd_docs(spark))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 10 and by[0][0].text is None and by[1][0].text == "" and by[2][0].text == " \n\t "
    assert sorted(r.text for r in by[4]) == ["", "one two three four five\n"]
    assert by[7][0].n_dropped == 0 and by[3][0].text == "one" and by[3][0].size == "clash"
    assert drop_lines(docs(spark, [])).count() == 0


def test_variants_that_share_32_bits_all_reach_their_buckets(monkeypatch):
    whole, without = Lines.whole, Lines.without
    low = np.uint64((1 << 32) - 1)
    # the upper halves of the keys, which are sent, are made to clash
    monkeypatch.setattr(Lines, "whole", lambda self, *base: whole(self, *base) if base else whole(self) & low)
    monkeypatch.setattr(Lines, "without", lambda self, *base: without(self, *base) if base else without(self) & low)
    lines = Lines([b"\n".join(b" ".join(b"w%d" % (7 * k + i) for i in range(6)) for k in range(40))])
    v = Variants(lines, np.ones(len(lines.size), bool), 32)
    sent = set(v.keys.packed(0, np.uint32).column("bucket").to_pylist())
    assert sent == set((v.other % np.uint64(32)).tolist()) and len(sent) == 32
