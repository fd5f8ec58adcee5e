import json


import pytest
from pyspark.sql import functions as F

from tamis.session import checkpoint_dir, durable
from tamis.sources import files, sinks
from tamis.streaming import ingest


def test_json_folder_with_bad_files_and_order(spark, tmp_path):
    (tmp_path / "D1").mkdir()
    for name, text in {"b.json": '{"dossier_id": "D1", "file": "b.png", "blocks": []}', "a.json": '{"dossier_id": "D1",\n "file": "a.png"}', "c.json": "[broken"}.items():
        (tmp_path / "D1" / name).write_text(text)
    good, bad = files.json_objects(spark, str(tmp_path), files.PAGE)
    rows = files.with_ordinal(files.key_of_path(good, out="from_path"), "dossier_id").orderBy("doc_ordinal").collect()
    assert [(r.file, r.doc_ordinal, r.from_path) for r in rows] == [("a.png", 1, "D1"), ("b.png", 2, "D1")]
    assert bad.count() == 1
    done = spark.createDataFrame([("a.png",)], "file STRING")
    assert [r.file for r in files.not_done(good.select("file"), done, "file").collect()] == ["b.png"]


def test_images_manifest_and_originals(spark, tmp_path):
    (tmp_path / "x.PNG").write_bytes(b"1")
    (tmp_path / "y.jpg").write_bytes(b"12")
    assert [r.length for r in files.images(spark, str(tmp_path)).collect()] == [2]
    m = spark.createDataFrame([("D1", [(None, "p/a.png", "CIN", "CIN_1", "OK"), ("k", "b.png", "RIB", "RIB_1", "OK")])], files.MANIFEST)
    assert [r.doc_id for r in files.manifest_documents(m, "CIN_1").collect()] == ["D1_p/a"]
    docs = spark.createDataFrame([("1", "p/a.png", "a.png"), ("2", "?", "b.jpg"), ("3", "?", "c.png"), ("4", "?", "z.png")], "k STRING, original_path STRING, file STRING")
    there = spark.createDataFrame([("p/a.png",), ("q/b.jpg",), ("r/b.jpg",), ("q/c.tif",)], "source_file STRING")
    assert {r.k: r.found_path for r in files.original_of(docs, there).collect()} == {"1": "p/a.png", "2": "q/b.jpg", "3": "q/c.tif", "4": None}
    (tmp_path / "w.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.parameters(str(tmp_path / "w.json"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, None)], "k STRING, v INT, l ARRAY<STRING>")
    path = str(tmp_path / "t")
    sinks.write_partitions(df, path, "k")
    sinks.write_partitions(df.filter("k = 'a'").withColumn("v", F.lit(9)), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "l", "absent"])
    assert {(r.v, r.l, r.absent) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("1", "x|y", None), ("2", None, None)}
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    edges = sinks.result_edges(df.withColumn("c", F.lit("CHECK")), "k", "c", "l", "PROOF").collect()
    assert sorted((r.signal_id, r.evidence, r.role) for r in edges) == [("a_CHECK", "x", "PROOF"), ("a_CHECK", "y", "PROOF")]


def test_checkpoint_folder_is_shared_and_ends_the_lineage(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    assert sorted(r.id for r in durable(spark.range(3)).collect()) == [0, 1, 2]


def test_stream_of_records_equals_the_batch(spark, tmp_path):
    payload = json.dumps({"documents": [{"doc_id": "A", "fields": [{"field_name": "f"}]}]})
    source = tmp_path / "in"
    schema = "raw_id BIGINT, payload STRING, recu_at TIMESTAMP"
    rows = spark.createDataFrame([(1, payload), (2, payload), (2, payload)], "raw_id BIGINT, payload STRING").withColumn("recu_at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    rows.select("raw_id", "payload", "recu_at").coalesce(1).write.parquet(str(source))
    stream = ingest.once(ingest.record_stream(spark, str(source)))
    q = ingest.write_tables(ingest.shred_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.record_id, r.niveau) for r in got.collect()) == [(1, "document"), (1, "field"), (2, "document"), (2, "field")]
    assert spark.read.schema(schema).parquet(str(source)).count() == 3
    counts = ingest.counts_by_window(ingest.record_stream(spark, str(source)).withColumn("kind", F.lit("r")), "recu_at", "kind")
    w = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert [r.n for r in spark.sql("SELECT * FROM w").collect()] == [3]
