import random

import xxhash
from pyspark.sql import functions as F

from sandpiper.llm import simhash
from sandpiper.llm.queries import op4_simhash_neardup
from sandpiper.llm.simhash import fingerprint, near_duplicates, neighbours, one_of_each

from . import test_jaccard
from .helpers import docs, odd_docs, with_clashes


def brute(rows):
    def fp(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, fp(t)) for i, t in rows]
    up = {i: i for i, _ in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {(i, f"{a:016x}", top(i)) for i, a in prints}


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op4_simhash_neardup(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_chains_reach_the_smallest_id(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        words[rng.randrange(60)] = f"n{rng.random()}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert {tuple(r) for r in near_duplicates(docs(spark, texts)).collect()} == brute(rows)


def test_odd_rows(spark):
    got = near_duplicates(with_clashes(odd_docs(spark))).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == "0" * 16 and by[2].component_id == 0
    assert sum(r.doc_id == 4 for r in got) == 2
    kept = one_of_each(with_clashes(odd_docs(spark)))
    assert "component_id" in kept.columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6, 7, None}
    assert near_duplicates(docs(spark, [])).count() == 0


def test_the_stage_gets_its_links_by_fingerprints(spark, monkeypatch):
    """Near copies within two bits are met by their fingerprints; the exact join is left what lies further apart, and nothing is missed."""
    rng = random.Random(8)
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:399], f"n{k}"]), " ".join(words[: 330 + rng.randrange(40)])]
    prints = [fingerprint(t.encode(), 5) for t in texts]
    close = {(i, j) for j in range(len(texts)) for i in range(j) if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 2}
    pairs = neighbours(docs(spark, texts).select(F.col("doc_id").alias("node"), "text")).collect()
    assert {(min(p), max(p)) for p in pairs} <= close and len(pairs) == len(set(pairs)) > 10
    reached = [set(p) for p in pairs]
    assert {i for p in close for i in p} == set().union(*reached)
    asked = []
    monkeypatch.setattr(simhash, "neighbours", lambda *given: asked.append(neighbours(*given)) or asked[-1])
    assert {r.doc_id for r in one_of_each(docs(spark, texts)).collect()} == test_jaccard.kept(texts)
    assert len(asked) == 1


def test_links_of_fingerprints_are_verified(spark, monkeypatch):
    """Whatever meets, only similar sets are one group; and what the fingerprints miss is found."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join(words[:95]), " ".join(words[:40]), "of its own", " ".join(words[40:])]
    for pairs in ([], [(0, 1), (1, 2), (2, 3), (0, 4), (3, 4)]):

        def some(nodes, *_, pairs=pairs):
            of = {r.text: r.node for r in nodes.collect()}
            return spark.createDataFrame([(of[texts[a]], of[texts[b]]) for a, b in pairs], "a long, b long")

        monkeypatch.setattr(simhash, "neighbours", some)
        assert {r.doc_id for r in one_of_each(docs(spark, texts)).collect()} == {0, 2, 3, 4} == test_jaccard.kept(texts)
