import zlib

from pyspark.sql import functions as F

from passbook.operators import accounts
from passbook.sources import guards, keyed, ledgers, tokens
from passbook.streaming import ledger_stream


def test_uploads_and_streams(spark, tmp_path):
    body = zlib.compress(b"BT (Hello \\(world\\)) Tj [(Bal) -20 <616E6365>] TJ ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nstream\n" + body + b"\nendstream\n")
    files = guards.uploads(spark, str(tmp_path))
    assert {r["raw_text"] for r in tokens.stream_text(files).collect()} == {"Hello (world)\nBalance"}
    got = tokens.extract(files, lambda content: [(1, w.decode("latin-1"), 1.0, 0, 0, 1, 1) for w in content.split()[:2]])
    assert got.count() == 2 and got.first()["page"] == 1
    assert tokens.synthetic(spark).count() == 8


def test_saved_results(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.range(50).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"), F.col("id").alias("created_at"))
    ledgers.save(rows, path)
    ledgers.save(rows.where("id = 7").withColumn("created_at", F.lit(99).cast("long")), path)
    assert ledgers.history(spark, path, 3).select("request_id").first()[0] == "r7"
    assert ledgers.result(spark, path, "r7").first()["created_at"] == 99 and spark.read.parquet(path).count() == 50


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    led = ledgers.events(spark, sf_dir)
    led.write.parquet(str(tmp_path / "in"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in led.schema)
    ledger_stream.follow(spark, str(tmp_path / "in"), kinds, accounts.monthly_cash_flow, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = ledger_stream.current(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, accounts.monthly_cash_flow(led).select(got.columns).collect()))


def test_accounts_over_two_arrivals(spark, sf_dir, tmp_path):
    led = ledgers.events(spark, sf_dir)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in led.schema)
    where = {k: str(tmp_path / k) for k in ("in", "out", "cp")}
    for part in (0, 1):
        led.where(F.col("id") % 2 == part).write.mode("append").parquet(where["in"])
        ledger_stream.follow(spark, where["in"], kinds, accounts.monthly_cash_flow, where["out"], where["cp"]).awaitTermination()
    got = ledger_stream.current(spark, where["out"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, accounts.monthly_cash_flow(led).select(got.columns).collect()))


def test_hourly_totals_stream(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("type"), F.col("value").alias("amount"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = ledger_stream.hourly_totals(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == e.count()


def statements(spark, ids, status, at):
    return spark.createDataFrame([(f"d{i}", at, status) for i in ids], "document_id string, created_at long, status string")


def test_upserts_by_document(spark, tmp_path):
    """Two upserts and a repeated and a late one give one row a document; other partitions keep their files."""
    path = str(tmp_path / "t")
    keyed.upsert(statements(spark, range(40), "new", 1), path, batch=1)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    changed = statements(spark, (3, 3, 7), "done", 2)
    for batch, rows in ((2, changed.unionByName(statements(spark, (7,), "last", 3))), (2, changed.unionByName(statements(spark, (7,), "last", 3))), (1, statements(spark, range(40), "new", 1))):
        keyed.upsert(rows, path, batch=batch)
        got = {r["document_id"]: r["status"] for r in keyed.read(spark, path).collect()}
        assert got == {f"d{i}": {3: "done", 7: "last"}.get(i, "new") for i in range(40)}
        if batch == 2:
            same = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
            assert len(before) - 2 <= len(same) < len(before)
    assert keyed.get(spark, path, "document_id", "d7").first()["status"] == "last"
    plan = keyed.get(spark, path, "document_id", "d7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__part" in plan
    assert keyed.newest(spark, path, 1).first()["document_id"] == "d7"


def test_upserts_of_a_stream(spark, tmp_path):
    where = {k: str(tmp_path / k) for k in ("in", "out", "cp")}
    for k, ids in enumerate((range(6), range(3, 9))):
        statements(spark, ids, f"s{k}", k).write.mode("append").parquet(where["in"])
        stream = spark.readStream.schema("document_id string, created_at long, status string").parquet(where["in"])
        keyed.into(stream, where["out"], "document_id", where["cp"]).awaitTermination()
    assert {r["document_id"]: r["status"] for r in keyed.read(spark, where["out"]).collect()} == {f"d{i}": "s1" if i >= 3 else "s0" for i in range(9)}
