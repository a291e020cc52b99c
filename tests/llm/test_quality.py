import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sandpiper.llm import quality
from sandpiper.llm.quality import judged, keep_good
from sandpiper.llm.queries import op1_quality_rules

from .helpers import docs, odd_docs, with_clashes


def surface(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for s in range(len(words) - 7):
        at[tuple(words[s : s + 8])].append(s)
    covered = {s + k for places in at.values() if len(places) > 1 for s in places for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def base_failed(s):
    return s[0] < 20 or 100 * s[4] > 30 * s[0]


def model(train, grams):
    """Modified Kneser-Ney of order 5 from the counts in train, for all grams."""
    levels = {5: {g: train[g] for g in grams}}
    for k in range(4, 0, -1):
        low = Counter()
        for g, c in levels[k + 1].items():
            low[g[1:]] += c > 0
        levels[k] = dict(low)
    known = {}
    for k in range(1, 6):
        level = levels[k]
        n = [sum(c == i for c in level.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0.0] * 4
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5
            d[i] = min(i, max(0, raw))
        ctx = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in level.items():
            x = ctx[g[:-1]]
            x[0] += c
            if c:
                x[min(c, 3)] += 1
        now = {}
        for g, c in level.items():
            s, *m = ctx[g[:-1]]
            lower = known[g[1:]] if k > 1 else 1 / (len(level) + 1)
            now[g] = (c - d[min(c, 3)]) / s + sum(a * b for a, b in zip(d[1:], m, strict=True)) / s * lower if s else lower
        known = now
    return known


def brute(rows):
    """Surface counts, and bits a character (the end counts as one) under the model counted from all texts of the other fold."""
    stats = {i: surface(t) for i, t, _ in rows}
    train, grams, cut, fold = defaultdict(Counter), defaultdict(set), {}, {}
    for i, t, lang in rows:
        framed = "\x02" * 4 + (t or "") + "\x03"
        cut[i] = [framed[k : k + 5] for k in range(len(framed) - 4)]
        fold[i] = xxhash.xxh64_intdigest((t or "").encode()) & 1
        grams[lang].update(cut[i])
        train[lang, 1 - fold[i]].update(cut[i])
    p = {(lang, f): model(train[lang, f], grams[lang]) for lang in grams for f in (0, 1)}
    bits = {i: -sum(math.log2(p[lang, fold[i]][g]) for g in cut[i]) / len(cut[i]) for i, _, lang in rows}
    return stats, bits


def bands(rows, stats, bits, below=6.0, above=8.0, least=0.35):
    out = {}
    for lang in {x for _, _, x in rows}:
        own = sorted(round(bits[i], 5) for i, _, x in rows if x == lang and not base_failed(stats[i]))
        if own:
            lo, hi = np.quantile(own, [0.25, 0.75])
            out[lang] = lo - max(least, below * (hi - lo)), hi + max(least, above * (hi - lo))
    return out


def n4(rows):
    return [(r.doc_id, r.text, r.lang) for r in rows.collect()]


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = n4(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stats, bits = brute(rows)
    band, lang = bands(rows, stats, bits), {i: x for i, _, x in rows}
    got = op1_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats[r.doc_id]
        assert r.base_failed == base_failed(stats[r.doc_id])
        assert r.bits == pytest.approx(bits[r.doc_id], rel=1e-4)
        lower, upper = band[lang[r.doc_id]]
        assert (r.lower, r.upper) == (pytest.approx(lower, rel=1e-4), pytest.approx(upper, rel=1e-4))
        assert r.kept == (not r.base_failed and lower <= bits[r.doc_id] <= upper)
    assert 0.5 * len(got) < sum(r.kept for r in got) < len(got)


def test_a_model_too_large_to_broadcast_gives_the_same(spark, sf_dir, monkeypatch):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 800")
    a = {r.doc_id: r for r in judged(some).collect()}
    monkeypatch.setattr(quality, "PART_ROWS", 5000)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(quality, "PROBING", 4)
    b = {r.doc_id: r for r in judged(some, model_limit=10).collect()}
    assert a.keys() == b.keys() and all(a[i].kept == b[i].kept and a[i].bits == pytest.approx(b[i].bits, abs=2e-4) for i in a)


def test_labels_and_bands_on_the_real_table(spark):
    """Good text stays, and both bands reject some."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op1_quality_rules(spark, sf).collect() if not r.base_failed]
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    assert len(good) > 3000 and sum(good) / len(good) > 0.99
    above, below = [r for r in rows if r.bits > r.upper], [r for r in rows if r.bits < r.lower]
    assert above and below and all(not r.kept for r in above + below)


def english(spark, n=300):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").limit(n)


def prose(rows, n=20):
    """Kept texts of some length without symbols."""
    kept = {r.doc_id for r in judged(rows).filter("kept AND n_words > 100 AND n_symbols = 0").collect()}
    return [r.text for r in rows.collect() if r.doc_id in kept][:n]


def planted(spark, rows, texts):
    more = spark.createDataFrame([(900_000 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)], rows.schema)
    by = {r.doc_id: r for r in judged(rows.unionByName(more)).filter("doc_id >= 900000").collect()}
    return [by[900_000 + k] for k in range(len(texts))]


def test_length_of_words_is_no_reason(spark):
    """Prose whose words are joined, two by two with a hyphen or three by three, stays."""
    rows = english(spark)
    texts = prose(rows)
    assert len(texts) == 20

    def joined(text, k, mark):
        words = text.split()
        return " ".join(mark.join(words[i : i + k]) for i in range(0, len(words), k))

    for k, mark in ((2, "-"), (2, ""), (3, "-")):
        got = planted(spark, rows, [joined(t, k, mark) for t in texts])
        assert all(r.kept for r in got), (k, mark, [(r.bits, r.lower, r.upper) for r in got if not r.kept])


def test_shuffled_characters_go(spark):
    rows, rng = english(spark), random.Random(4)
    texts = prose(rows)
    got = planted(spark, rows, ["".join(rng.sample(t, len(t))) for t in texts])
    assert not any(r.kept for r in got) and all(r.bits > r.upper for r in got if not r.base_failed)


def test_both_bands_reject_planted_text(spark):
    rng = random.Random(3)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").limit(300)
    few = ["the", "of", "and", "to", "in", "is", "that", "it"]
    regular = " ".join(rng.choice(few) for _ in range(120))
    noise = " ".join("".join(rng.choice("qxzjkvw0123456789#") for _ in range(8)) for _ in range(60))
    planted = spark.createDataFrame([(900_001, regular, "en", "s", 1), (900_002, noise, "en", "s", 1), (900_003, noise, "en", "s", 1)], rows.schema)
    by = {r.doc_id: r for r in judged(rows.unionByName(planted)).filter("doc_id > 900000").collect()}
    assert not any(r.base_failed or r.kept for r in by.values())
    assert by[900_001].bits < by[900_001].lower and by[900_002].bits > by[900_002].upper
    assert by[900_002].bits == by[900_003].bits  # a copy doesn't vouch for it


def test_rows_stay_by_their_own_text(spark):
    """Null and repeated ids don't vouch for other rows; a repeated good row stays as often as it stands there."""
    good = prose(english(spark), 1)[0]
    rows = [(None, "too short", "en"), (None, "x y z", "en"), (None, good, "en"), (7, good, "en"), (7, "too short", "en"), (7, None, "en"), (8, good, None), (8, good, None)]
    few = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for limit in (quality.REJECTED_LIMIT, -1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(quality, "REJECTED_LIMIT", limit)
            got = Counter((r.doc_id, r.text, r.lang) for r in keep_good(few).collect())
        assert got == Counter([(None, good, "en"), (7, good, "en"), (8, good, None), (8, good, None)])


def test_odd_rows(spark):
    got = judged(with_clashes(odd_docs(spark))).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[0].base_failed and by[1].n_words == 0 and by[5].n_repeat_words == 30_000 and by[4].n_dup_lines == 2
    assert all(r.kept is not None and r.bits is not None for r in got)
    assert judged(docs(spark, [])).count() == 0
    kept = keep_good(with_clashes(odd_docs(spark)))
    assert kept.columns == with_clashes(odd_docs(spark)).columns
