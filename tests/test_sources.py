import gzip
import json
import time

from pyspark.sql import functions as F

from litmill import sources
from litmill.plans import CleanConfig, clean, merge_sources
from litmill.sources.readers import any_of, none_of
from litmill.streaming import last_success, log_rates, run_log_upserts

from test_operators import RECORDS, record


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n{"a": 2}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write('{"a": 3}\n{"a": \n')
    assert sources.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").count() == 2
    assert sources.read_json_lines(spark, str(tmp_path / "b.jsonl.gz"), "a int", parts=2).collect()[0]["a"] == 3
    kept = sources.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string", "keep").cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    (tmp_path / "cache.json").write_text(json.dumps({"k": {"x": 1}, "miss": {}}))
    assert {r["key"]: r["x"] for r in sources.read_cache(spark, str(tmp_path / "cache.json"), "x:int").collect()} == {"k": 1, "miss": None}
    (tmp_path / "r.xml").write_text("<all><article key='1'><title>A</title><author>x</author><author>y</author></article><www><title>B</title></www></all>")
    rows = sources.read_xml(spark, str(tmp_path / "r.xml"), ["article", "www"], "_key string, title string, author array<string>").collect()
    assert sorted((r["type"], r["title"], tuple(r["author"] or ())) for r in rows) == [("article", "A", ("x", "y")), ("www", "B", ())]
    assert none_of(any_of("TS", ["a-b", "c"]), "TS", ["d e"]) == 'TS=("a-b" OR c) NOT TS=("d e")' and none_of("x", "TS", []) == "x"


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3).withColumn("x", F.lit("a|b"))
    sources.replace_table(df, path)
    sources.replace_table(spark.read.parquet(path).where("id > 0"), path)
    sources.replace_table(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(f"{path}.bak").count() == 3
    assert sources.write_audit(df, str(tmp_path / "c"), ["x", "none"]) and not sources.write_audit(df.limit(0), str(tmp_path / "d"), ["x"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["x"]
    sources.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert "| id | x |" in sources.Report().add("T", df).text()


LOG = "status string, row_index bigint, topic string, total_tokens int, logged_at timestamp, received_at timestamp"


def test_log(spark, tmp_path):
    t = lambda h: f"2025-01-01 {h:02d}:00:00"
    rows = [("success", 1, "A", 5, t(1), t(1)), ("success", 1, "B", 5, t(2), t(2)), ("success", 1, "B", 5, t(2), t(2)), ("failed", 1, None, None, t(3), t(3)), ("failed", 2, None, None, t(1), t(1)), ("success", None, "C", 1, t(1), t(1))]
    df = spark.createDataFrame([(*r[:4], *r[4:]) for r in rows], "status string, row_index bigint, topic string, total_tokens int, logged_at string, received_at string").selectExpr("status", "row_index", "topic", "total_tokens", "timestamp(logged_at) logged_at", "timestamp(received_at) received_at")
    assert [(r["row_index"], r["topic"]) for r in last_success(df).collect()] == [(1, "B")] and last_success(df, retry_failed=True).count() == 0
    assert log_rates(df).count() == 3 and last_success(df.limit(0)).count() == 0
    for k in (0, 1):
        df.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        run_log_upserts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert [(r["row_index"], r["topic"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "B")]
        time.sleep(0.1)
    counted = log_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 minute")
    q = counted.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rates").count() == 3


def test_stages(spark):
    rows = [record(1, "Agent-based model", "10.1/a", abstract=None), record(2, "Other", None, abstract=" "), record(3, "Модель", None, abstract="x"), record(4, "Other!", None, abstract="y"), record(5, "", None, abstract="z")]
    df = spark.createDataFrame(rows, RECORDS)
    kept, removed, ledger = clean(df, CleanConfig(drop_uncited=True))
    assert kept.count() == 0 and ledger.agg(F.sum("removed")).first()[0] == 5
    kept, removed, _ = clean(df)
    assert {r["rec_id"]: r["abstract_missing"] for r in kept.collect()} == {1: True, 4: False, 5: False}
    assert {r["rec_id"]: r["drop_reason"] for r in removed.collect()} == {2: "no abstract", 3: "title in another script"}
    assert sorted(r["n_merged"] for r in merge_sources(df).collect()) == [1, 1, 1, 2]


def test_broken_replacement(spark, tmp_path):
    """A job that died between the two renames leaves a table that the next reader or writer puts in place."""
    from litmill.sources.writers import restore_table

    path = str(tmp_path / "t")
    sources.replace_table(spark.range(3), path)
    sources.replace_table(spark.range(4), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    spark.range(5).write.parquet(path + ".new")
    assert sources.read_table(spark, path).count() == 5 and not (tmp_path / "t.old").exists() and not restore_table(spark, path)
    sources.replace_table(spark.range(6), path)
    assert sources.read_table(spark, path).count() == 6 and spark.read.parquet(path + ".bak").count() == 3


def test_release(spark):
    from litmill.session import materialize, release, shared_folder

    release(spark)
    kept = materialize(spark.range(3), "kept")
    files = kept.inputFiles()
    assert kept.count() == 3 and release(spark) == 1 and release(spark) == 0
    from pathlib import Path

    assert files[0].startswith("file:") and not Path(files[0].replace("file://", "")).exists() and shared_folder(spark)
