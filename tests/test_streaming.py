"""The stream gives what the batch gives, over several batches."""

from posegrid.operators.retarget import contact_lock
from posegrid.streaming import contact


def test_contact_lock_stream(spark, tmp_path):
    rows = [(c, f, (f // 3) % 2 == 1, float(f * (1 + i))) for i, c in enumerate("ab") for f in range(12)]
    schema = "clip string, frame int, active boolean, v double"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = contact.contact_lock(stream).writeStream.format("memory").queryName("locked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["clip"], r["frame"]): r["correction"] for r in contact_lock(spark.createDataFrame(rows, schema)).collect()}
    got = {(r["clip"], r["frame"]): r["correction"] for r in spark.table("locked").collect()}
    assert got == want
