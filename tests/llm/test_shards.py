import zlib

from sandpiper.llm.queries import op8_sharding
from sandpiper.llm.shards import shard_documents

from .helpers import docs, odd_docs, with_clashes


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_against_the_plain_loop(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_sharding(spark, sf_dir).collect()
    assert len(got) == len(texts)
    slots = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41))
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    got = shard_documents(with_clashes(odd_docs(spark)).repartition(3)).collect()
    assert len(got) == 10
    assert {r["size"] for r in got if r.doc_id in (0, 1)} == {16}
    assert len({(r.shard, r.slot) for r in got}) == 10
    assert shard_documents(docs(spark, [])).count() == 0
