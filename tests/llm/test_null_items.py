"""Benchmark items without an item_id."""

import hashlib

from test_contracts import frame

from hushline.llm import decontamination, queries


def test_null_item_ids_are_searched(spark, tmp_path):
    first, second, third = (" ".join(f"{c}{i}" for i in range(20)) for c in "abc")
    docs = frame(spark, [(1, first), (2, f"{first} {second} {third}"), (3, "clean")])
    bench = spark.createDataFrame([(None, first), (None, second), (7, third)], "item_id long, text string")
    for part_bytes in (1 << 20, 40):
        found = decontamination.search(decontamination.build_index(docs), bench, part_bytes=part_bytes)
        got = {r["doc_id"]: (sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in found.collect()}
        assert got == {1: (20, [None]), 2: (60, ["7", None]), 3: (0, [])}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: (r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op4_decontamination(spark, str(tmp_path)).collect()}
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert rows == {1: (1, digest(""), True), 2: (2, digest("7"), True), 3: (0, digest(""), False)}  # as the query's SQL has it
