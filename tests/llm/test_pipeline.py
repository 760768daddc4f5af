import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_packing import check_pieces
from test_quality import brute as brute_quality
from test_secret_scan import brute_base
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from folioforge.llm import common, quality, secret_scan


def test_every_stage_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents")
    near = docs.orderBy(F.desc("n_chars")).limit(8).selectExpr("doc_id + 1000000 as doc_id", "concat(text, ' end.') as text", "lang", "source", "n_chars + 5 as n_chars")
    docs = docs.unionByName(near).withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\ntoken=abcdef123456"))).otherwise(F.col("text")))
    docs = common.materialize(docs.withColumn("n_chars", F.char_length("text").cast("long")))
    before = docs.collect()
    model = quality.train(docs, common.table(spark, sf, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            lib = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
            check_pieces(out.collect(), {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 0] for r in before})
            break
        assert out.dtypes == docs.dtypes
        docs = common.materialize(out)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        assert len(ids) == len(after)
        if name == "quality_rules":
            bad = {r.doc_id for r in before if brute_quality(r.text)[5]}
            assert ids == {r.doc_id for r in before if r.doc_id not in bad and quality.judge(r.text.encode(), model, quality.THRESHOLD)[6]}
        if name == "exact_dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
                best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
            assert ids == {d for _, d in best.values()}
        if name == "simhash_near_dedup":
            rows = sorted(before, key=lambda r: r.doc_id)
            roots = brute_components([brute_fingerprint(r.text) for r in rows])
            assert ids == {rows[c].doc_id for c in roots} and len(ids) < len(rows)
        if name == "secret_scan":
            old = {r.doc_id: r.text for r in before}
            assert ids == set(old) and sum(r.text != old[r.doc_id] for r in after) > 0
            for r in after:
                assert r.n_chars == len(r.text) and not brute_base(r.text)
                assert (r.text == old[r.doc_id]) == (not secret_scan.scan(old[r.doc_id].encode())[1])
        before = after


def test_empty_and_odd_documents(spark, sf):
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "", None, None, None), (2, "w " * 50000, "en", "s", 100000)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == df.columns
