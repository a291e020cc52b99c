import hashlib
import re

from sandpiper.llm.queries import op10_substring_dedup
from sandpiper.llm.substrings import drop_repeats, removal_digest

from .helpers import docs, odd_docs, with_clashes


def brute(rows, k=20):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - k + 1):
            w = tuple(words[s : s + k])
            if w in seen:
                gone.update(range(s, s + k))
            seen.add(w)
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return set(out)


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op10_substring_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_small_chunks_and_overlaps(spark, monkeypatch):
    from sandpiper.llm import chunks

    texts = [" ".join(f"w{(i * 7 + k) % 40}" for k in range(30 + i)) for i in range(60)]
    monkeypatch.setattr(chunks.chunked, "__defaults__", (300,))
    got = {tuple(r) for r in removal_digest(docs(spark, texts).repartition(3), 5).collect()}
    assert got == brute(enumerate(texts), 5)


def test_odd_rows(spark):
    got = drop_repeats(with_clashes(odd_docs(spark))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[0].text is None and by[0].n_words == 0
    assert by[5].n_removed == 30_000 - 1 + 0 or by[5].n_removed == 29_999
    assert by[5].kept_words == "word" and by[5].text == "word "
    assert by[1].n_words == 0 and by[7].kept_words == "x" * 200_000 and by[3].size == "clash"
    assert drop_repeats(docs(spark, [])).count() == 0
