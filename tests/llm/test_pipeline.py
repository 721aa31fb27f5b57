"""The pipeline against the plain versions, stage by stage."""

import brute
import corpus_pipeline
import public_tokenizers
import sentencepiece
import test_near_copies
from test_contracts import SF, frame, hostile

import __spark_entry__ as entry
from hushline.session import stored


def plain(docs, items):
    kept = [(d, t) for d, t in docs if not brute.quality(t)["base_failed"]]
    kept = [(d, t) for d, _, _, t in brute.line_dedup(kept)]
    kept = [kept[i] for i in test_near_copies.kept(kept)]
    kept = [r for r, c in zip(kept, brute.contamination(kept, items)) if not c[5]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(d, t, library.encode(t)) for d, t in kept]


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = entry.queries()["pipeline"](spark, SF).orderBy("doc_id").collect()
    want = plain(docs, items)
    # the labels of this size are too few for any cutoff, so the base rules decide alone
    assert [(r["doc_id"], r["text"], r["ids"]) for r in got] == want and 50 < len(want) < len(docs)
    assert all(r["round_trip"] and r["n_chars"] == len(r["text"]) for r in got)


def test_stages_on_hostile_rows(spark):
    docs = frame(spark, hostile(11) + [(None, "a b " * 40), (None, None)])
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "test")
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and tuple(out.columns[:5]) == corpus_pipeline.COLUMNS
        assert (out.count() == docs.count()) or name in ("quality", "near_duplicates", "decontaminated")
