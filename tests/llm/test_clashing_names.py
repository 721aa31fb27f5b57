"""Extra columns named like the operators' own change nothing and pass through where rows do."""

import corpus_pipeline
import public_tokenizers
from test_contracts import CLASHING, SF, clashing, frame, hostile

from hushline.llm import decontamination, line_dedup, quality_rules, sentencepiece_codec, sharding, simhash, suffix_dedup, toxicity


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_results_do_not_depend_on_other_columns(spark):
    docs = hostile(12)
    plain, odd = frame(spark, docs), clashing(spark, docs)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, docs[7][1])], "item_id long, text string")
    assert same(quality_rules.judge(plain, labels), quality_rules.judge(odd, labels))
    assert same(sharding.interleave(plain), sharding.interleave(odd))
    assert same(simhash.near_duplicates(plain), simhash.near_duplicates(odd))
    assert same(decontamination.contamination(plain, bench), decontamination.contamination(odd, bench))
    assert same(suffix_dedup.deduplicate(plain).drop("kept"), suffix_dedup.deduplicate(odd).drop("kept"))
    assert same(toxicity.detect(plain, labels, {"toxic": "toxic = 1"}), toxicity.detect(odd, labels, {"toxic": "toxic = 1"}))


def test_columns_pass_through(spark):
    docs = hostile(13)
    plain, odd = frame(spark, docs), clashing(spark, docs)
    lines = line_dedup.deduplicate(odd)
    assert same(lines.select("doc_id", "text", "n_lines", "n_removed"), line_dedup.deduplicate(plain).select("doc_id", "text", "n_lines", "n_removed"))
    assert {r["_hash"] for r in lines.collect()} == {"own _hash"} and "n_lines" not in lines.columns[:-2]
    one = simhash.drop_near_duplicates(odd)
    assert one.columns == odd.columns and same(one.select("doc_id", "text"), simhash.drop_near_duplicates(plain).select("doc_id", "text"))
    coded = sentencepiece_codec.encode(odd, public_tokenizers.path("piece_bpe_32k.model"))
    assert coded.columns.count("ids") == 1 and {r["fp"] for r in coded.select("fp").collect()} == {"own fp"}
    for _, stage in corpus_pipeline.STAGES:
        assert set(CLASHING).isdisjoint(stage(spark, odd, SF).columns[:5])
