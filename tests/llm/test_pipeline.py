import corpus_pipeline
from pyspark.sql import functions as F

from . import test_jaccard, test_lines, test_packing, test_quality, test_substrings
from .helpers import odd_docs


def test_every_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        seen[name] = len(rows)
        if name == "packing":
            used, least = test_packing.sound(rows, {i: r.text for i, r in before.items()})
            assert used <= least + 3
            continue
        assert docs.columns == corpus_pipeline.COLUMNS
        texts = {i: r.text for i, r in before.items()}
        if name == "quality_rules":
            given = [(i, r.text, r.lang) for i, r in before.items()]
            stats, bits = test_quality.brute(given)
            band = test_quality.bands(given, stats, bits)
            assert {r.doc_id for r in rows} == {i for i, _, lang in given if not test_quality.base_failed(stats[i]) and band[lang][0] <= round(bits[i], 5) <= band[lang][1]}
            assert all(r == before[r.doc_id] for r in rows)
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in rows} == test_lines.brute_all(texts.items())
        if name == "simhash_neardup":
            ids = sorted(texts)
            assert {r.doc_id for r in rows} == {ids[k] for k in test_jaccard.kept([texts[i] for i in ids])}
        if name == "substring_dedup":
            want = {i: n - gone for i, n, gone, _ in test_substrings.brute(texts.items())}
            assert {r.doc_id: len((r.text or "").encode().split()) for r in rows} == want
    assert seen["quality_rules"] > 100 and seen["simhash_neardup"] <= seen["line_dedup"] == seen["quality_rules"]
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["packing"]


def test_odd_documents_go_through(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated rows, and an empty table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = odd_docs(spark)
    some = rows.unionByName(rows.limit(5)).unionByName(rows.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd)
    for k, table in enumerate((some, some.limit(0))):
        table.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert got.columns == corpus_pipeline.run(spark, f"{tmp_path}/1").columns if k else got.count() > 10
