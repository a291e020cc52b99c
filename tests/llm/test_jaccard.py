import random
from collections import Counter

from sandpiper.llm.simhash import one_of_each

from .helpers import docs


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(texts):
    """Ids that are the smallest of those they reach by a similarity of 0.8."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if top(i) == i}


def test_near_copies_around_the_similarity(spark):
    rng = random.Random(11)
    texts = ["", None, "a b", "A b", "a b c"]
    for size in (20, 45, 60, 120, 300):
        for _ in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(4):
                texts.append(" ".join(words))
                for _ in range(rng.randrange(1, 2 + size // 30)):
                    words[rng.randrange(size)] = f"n{rng.random()}"
                words = words[rng.randrange(3) :] + [f"e{rng.random()}"] * rng.randrange(3)
                size = len(words)
    # one family that meets in shared shingles, partly similar to each other, and others that share a passage only
    base = [f"b{k}" for k in range(100)]
    for _ in range(60):
        some = list(base)
        at = rng.randrange(90)
        some[at : at + rng.randrange(1, 9)] = [f"x{rng.random()}"]
        texts.append(" ".join(some))
    texts += [" ".join(base[:40] + [f"y{rng.random()}" for _ in range(rng.randrange(2, 40))]) for _ in range(40)]
    rng.shuffle(texts)
    want = kept(texts)
    got = [r.doc_id for r in one_of_each(docs(spark, texts).repartition(3)).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(texts) - 60


def test_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(3, text), (3, text), (None, text), (5, text + " more"), (None, "of its own"), (None, "of its own"), (7, "other"), (7, "words")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = one_of_each(frame).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, text), (None, "of its own"), (7, "other"), (7, "words")])
