import io
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushline.operators import guards, joins
from hushline.schemas import ContractError
from hushline.sources import audio, score_files, sinks, tables, wav_files


def write_wav(path, values, width=2, rate=16000):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    values = np.asarray(values, np.int64)
    raw = (values + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(
        int(v).to_bytes(width, "little", signed=True) for v in values.ravel()
    )
    with wave.open(path, "wb") as out:
        out.setnchannels(values.shape[1])
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(raw)


def test_wav_manifest_and_decode(spark, tmp_path):
    root = str(tmp_path / "audio")
    a = np.stack([np.arange(160), -np.arange(160)], 1)
    write_wav(f"{root}/ToyCar/test/normal_id_00_source_test_section_00.wav", a)
    write_wav(f"{root}/ToyCar/train/section_01_target_train_anomaly_0001.wav", a * 1000, width=3)
    write_wav(f"{root}/Fan/train/clip.wav", a // 2, width=1)
    rows = {r["file_id"]: r for r in audio.wav_manifest(spark, root).collect()}
    first = rows["ToyCar/test/normal_id_00_source_test_section_00.wav"]
    assert (first["machine_type"], first["section"], first["condition"], first["domain"], first["dataset_split"]) == (
        "ToyCar", "section_00", "normal", "source", "dev_test")
    assert (first["frames"], first["sample_rate"], first["channels"], first["subtype"], first["duration_seconds"]) == (160, 16000, 2, "PCM_16", 0.01)
    other = rows["ToyCar/train/section_01_target_train_anomaly_0001.wav"]
    assert (other["condition"], other["domain"], other["dataset_split"], other["subtype"]) == ("anomaly", "target", "dev_train", "PCM_24")
    assert (rows["Fan/train/clip.wav"]["section"], rows["Fan/train/clip.wav"]["condition"]) == ("unknown", "unknown")
    decoded = {r["relative_path"]: r for r in audio.stereo_clips(spark, root).collect()}
    np.testing.assert_allclose(decoded[first["file_id"]]["near"], np.arange(160) / 32768.0)
    np.testing.assert_allclose(decoded[other["file_id"]]["far"], -np.arange(160) * 1000 / 8388608.0)
    manifest = spark.createDataFrame([(first["file_id"], 7)], "relative_path string, clip_no long")
    samples = audio.sample_rows(audio.stereo_clips(spark, root), manifest)
    assert samples.agg(F.max("t")).first()[0] == 159 and samples.first()["samples"] == 160
    assert guards.audit_manifest(audio.wav_manifest(spark, root)).first()["stereo_clips"] == 3


def test_mono_and_empty_directories_are_rejected(spark, tmp_path):
    root = str(tmp_path / "mono")
    write_wav(f"{root}/ToyCar/train/normal.wav", np.zeros((10, 1), int))
    with pytest.raises(ContractError, match="Stereo"):
        guards.audit_manifest(audio.wav_manifest(spark, root))
    with pytest.raises(Exception, match="Expected stereo"):
        audio.stereo_clips(spark, root).collect()
    os.makedirs(tmp_path / "none")
    with pytest.raises(ContractError, match="No WAV"):
        audio.wav_manifest(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("tag,width,extensible", [(1, 1, False), (1, 2, True), (1, 3, True), (1, 4, False), (3, 4, True), (3, 8, False)])
def test_chunks_equal_whole_files(spark, tmp_path, tag, width, extensible):
    root = tmp_path / "with space, 100%25 é"
    values = np.stack([np.arange(-60, 65), np.arange(65, -60, -1)], 1) / 128.0
    (root / "Fan" / "train").mkdir(parents=True)
    content = wav_files.wav_bytes(values, 8000, tag, width, extensible)
    for name in ("a b.wav", "c#1?.wav"):
        (root / "Fan" / "train" / name).write_bytes(content)
    rows = {r["relative_path"]: r for r in audio.wav_manifest(spark, str(root)).collect()}
    assert set(rows) == {"Fan/train/a b.wav", "Fan/train/c#1?.wav"}
    assert {(r["frames"], r["channels"], r["subtype"]) for r in rows.values()} == {(125, 2, audio.SUBTYPES[tag, width])}
    near, far, rate = audio.decode(content, True, "x")
    np.testing.assert_array_equal(np.stack([near, far], 1), values)
    chunks = [r for r in audio.stereo_chunks(spark, str(root), 40, 9).collect() if r["relative_path"] == "Fan/train/a b.wav"]
    assert sorted((r["chunk"], r["start"], len(r["near"])) for r in chunks) == [(0, 0, 49), (1, 40, 49), (2, 80, 45), (3, 120, 5)]
    for r in chunks:
        np.testing.assert_array_equal(r["far"], values[r["start"] : r["start"] + 49, 1])
    manifest = spark.createDataFrame([("Fan/train/a b.wav", 7)], "relative_path string, clip_no long")
    long = audio.sample_rows(audio.stereo_chunks(spark, str(root), 40), manifest).orderBy("t").collect()
    assert [(r["t"], r["samples"], r["near"]) for r in long] == [(t, 125, v) for t, v in enumerate(values[:, 0])]


def test_broken_files_are_refused():
    good = wav_files.wav_bytes(np.zeros((4, 2)), 8000)
    read = lambda raw: audio.read_header(io.BytesIO(raw), "f.wav")
    assert read(good[:-4]).frames == 3 and read(good[:40] + b"\xff\xff\xff\xff" + good[44:]).frames == 4
    long = b"RF64" + b"\xff" * 4 + b"WAVE" + struct.pack("<4sIQQQI", b"ds64", 28, 0, 16, 4, 0) + good[12:40] + b"\xff" * 4 + good[44:] + b"rest"
    assert read(long).frames == 4
    for raw, message in ((b"", "Not a WAV"), (b"OggS" + good[4:], "Not a WAV"), (good[:36], "No samples"), (good[:12] + good[36:], "before their format"),
                         (good[:20] + b"\x07" + good[21:], "unknown kind")):
        with pytest.raises(ContractError, match=message):
            read(raw)
    loud = wav_files.wav_bytes(np.full((2, 2), np.inf), 8000, 3, 4)
    with pytest.raises(ContractError, match="not finite"):
        audio.decode(loud, True, "f.wav")


def test_paths_of_file_systems():
    assert audio.located("file:/a b/c%.wav") == ("", "/a b/c%.wav") and audio.located("/a:b/c.wav") == ("", "/a:b/c.wav")
    assert audio.located("s3a://bucket/x y/z.wav") == ("s3://bucket", "x y/z.wav")
    assert audio.located("hdfs://host:8020/x/z.wav") == ("hdfs://host:8020", "x/z.wav")


def test_score_files_parse_skip_and_reject(spark, tmp_path):
    (tmp_path / "anomaly_score_DCASE2026T2ToyCar_section_00_test_seed13711.csv").write_text("a.wav,0.5\n\nb.wav,1.5\n")
    (tmp_path / "anomaly_score_other.csv").write_text("skip,1,2\n")
    rows = sorted(tuple(r) for r in score_files.read_score_files(spark, str(tmp_path)).collect())
    assert rows == [("ToyCar", "section_00", "a.wav", 0.5), ("ToyCar", "section_00", "b.wav", 1.5)]
    (tmp_path / "anomaly_score_Fan_section_01_test.csv").write_text("a.wav,0.5,9\n")
    with pytest.raises(Exception, match="exactly a name and a score"):
        score_files.read_score_files(spark, str(tmp_path)).collect()


def test_unknown_basename_fails(spark):
    manifest = spark.createDataFrame([("x/a.wav", "x/a.wav", "ToyCar", "section_00", "source", "normal", "dev_test")],
                                     ["file_id", "relative_path", "machine_type", "section", "domain", "condition", "dataset_split"])
    good = spark.createDataFrame([("DCASE2026T2ToyCar", "section_00", "a.wav", 1.0)], ["machine_type", "section", "basename", "anomaly_score"])
    assert joins.label_official_scores(good, manifest, "m", "e").first()["file_id"] == "x/a.wav"
    bad = good.unionByName(good.withColumn("basename", F.lit("zzz.wav")))
    with pytest.raises(Exception, match="no clip named zzz.wav"):
        joins.label_official_scores(bad, manifest, "m", "e").collect()
    for official, message in ((good.limit(0), "No official score for"), (good.unionByName(good), "Repeated official score for")):
        with pytest.raises(Exception, match=f"{message} ToyCar section_00 a.wav"):
            joins.label_official_scores(official, manifest, "m", "e").count()
    with pytest.raises(Exception, match="Repeated manifest clip for"):
        joins.label_official_scores(good, manifest.unionByName(manifest), "m", "e").count()


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.range(3).withColumn("machine_type", F.lit("a"))
    sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_table(df, str(tmp_path / "t"))


def test_score_csv_contract(spark, tmp_path):
    rows = [(f"f{i}", "m", "s", "source", "normal", float(i), "x", "y") for i in range(3)]
    from hushline.schemas import SCORES

    sinks.write_scores(spark.createDataFrame(rows, SCORES), str(tmp_path / "ok"))
    assert tables.read_scores(spark, str(tmp_path / "ok")).count() == 3
    sinks.write_scores(spark.createDataFrame([*rows, rows[0]], SCORES), str(tmp_path / "twice"))
    with pytest.raises(ContractError):
        tables.read_scores(spark, str(tmp_path / "twice"))
    with pytest.raises(ContractError, match="missing required columns: frames, zeta"):
        tables.read_table(spark, "/root/testdata/sf0.001/nation.parquet", ["zeta", "n_name", "frames"])


def test_checksum_audit(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.bin").write_bytes(name.encode() * 10)
    actual = score_files.file_digests(spark, str(tmp_path), "*.bin", "md5")
    import hashlib

    want = [("a.bin", hashlib.md5(b"a" * 10).hexdigest()), ("b.bin", "0" * 32), ("z.bin", "1")]
    audit = score_files.checksum_audit(actual, spark.createDataFrame(want, ["file_name", "digest"]))
    assert {tuple(r) for r in audit.collect()} == {("a.bin", "ok"), ("b.bin", "mismatch"), ("c.bin", "unexpected"), ("z.bin", "missing")}


def test_guards_raise(spark):
    rows = [("a", "eval_test", "unknown"), ("b", "eval_test", "normal")]
    df = spark.createDataFrame(rows, ["file_id", "dataset_split", "condition"])
    with pytest.raises(ContractError, match="label"):
        guards.require_label_blind(df)
    with pytest.raises(ContractError, match="label"):
        guards.require_labelled(df)
    with pytest.raises(ContractError, match="missing=1, unexpected=1"):
        guards.require_coverage(df, spark.createDataFrame([("a",), ("c",)], ["file_id"]))
    with pytest.raises(ContractError, match="duplicate"):
        guards.require_unique(df.unionByName(df), ["file_id"])


def test_feature_tables_are_read_only_when_they_meet_their_contract(spark, tmp_path):
    schema = "file_id string, view string, domain string, values array<double>"
    good = [(f, view, "source", [1.0, 2.0]) for f in ("a", "b") for view in ("near", "refsub")]
    plants = {
        "wrong_width 1": ("b", "near", "source", [1.0]),
        "not_finite 1": ("b", "near", "source", [1.0, float("nan")]),
        "unknown_view 1": ("b", "Near", "source", [1.0, 2.0]),
        "missing_views 1": ("c", "near", "source", [1.0, 2.0]),
        "uneven_views 1": ("b", "near", "source", [1.0, 2.0]),
        "described_twice 1": ("b", "refsub", "target", [1.0, 2.0]),
    }
    spark.createDataFrame(good, schema).write.parquet(str(tmp_path / "good"))
    index = tables.read_feature_index(spark, str(tmp_path / "good"), "near", 2, ("near", "refsub"))
    assert index.count() == 4 and "near_vector_count" in index.columns
    for i, (fault, row) in enumerate(plants.items()):
        spark.createDataFrame([*good, row], schema).write.parquet(str(tmp_path / str(i)))
        with pytest.raises(ContractError, match=fault):
            tables.read_feature_index(spark, str(tmp_path / str(i)), "near", 2, ("near", "refsub"))
    empty = spark.createDataFrame([], schema)
    assert tables.feature_faults(empty, 2, ("near", "refsub")).count() == 0
