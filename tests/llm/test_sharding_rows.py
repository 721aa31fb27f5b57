"""Sharding of rows that ids or sources do not tell apart: nothing lost, nothing doubled, no single range."""

from pyspark.sql import functions as F

from hushline.llm import sharding


def test_write_shards_keeps_every_row(spark, tmp_path):
    rows = [(None, "a", f"text {i}", i) for i in range(10)] + [(7, "b", "same", 10), (7, "b", "same", 11), (8, None, None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int").withColumnRenamed("slot", "no")
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["no"] for r in back.collect()) == list(range(13))
    slots = back.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == list(range(r["n"])) for r in slots) and sorted(r["n"] for r in slots) == [3, 3, 3, 4]


def test_sources_of_one_row_and_rows_without_ids_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    lone = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("u"), "id").alias("source"), F.lit("x").alias("text"))
    one = lone.withColumn("source", F.lit("hot"))
    for docs in (lone, one):
        seen = {}
        real = sharding.stored

        def spy(df, purpose):
            out = real(df, purpose)
            if "_range" in out.columns:
                seen[purpose] = out.groupBy("_range").count().agg(F.count("*"), F.max("count")).first()
            return out

        monkeypatch.setattr(sharding, "stored", spy)
        placed = sharding.interleave(docs).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("s"), F.max("slot").alias("m")).collect()
        monkeypatch.setattr(sharding, "stored", real)
        assert {(r["n"], r["s"], r["m"]) for r in placed} == {(250, 250, 249)}
        assert all(n >= 30 and most <= 400 for n, most in seen.values()) and len(seen) == 2
