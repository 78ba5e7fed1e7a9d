"""Scans as a stream: restarts, leases, lineage, and the same end as the batch operator."""

import datetime as dt
import random

import pytest

pytest.importorskip("google.protobuf")

from veritome.operators import incremental
from veritome.sources.shared import new_path
from veritome.streaming import scan_state

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


class Told:
    """Marks in order, written as one file for each batch."""

    def __init__(self, spark):
        self.spark, self.n, self.folder = spark, 0, new_path(spark, "marks")
        self.out = new_path(spark, "states")

    def batch(self, *marks):
        rows = []
        for mark, run, hours, more in marks:
            self.n += 1
            rows.append((mark, run, more.get("path"), more.get("size"), more.get("modified"), more.get("resumed"), at(more["lease"]) if "lease" in more else None, more.get("status"), at(hours), self.n))
        self.spark.createDataFrame(rows, scan_state.MARKS).coalesce(1).write.mode("append").parquet(self.folder)

    def run(self):
        """Starts the stream again where it stopped, and ends it when all is read."""
        scan_state.rocksdb(self.spark)
        read = self.spark.readStream.schema(scan_state.MARKS).option("maxFilesPerTrigger", 1).parquet(self.folder)
        states = scan_state.scan_states(read, buckets=3)
        states.writeStream.option("checkpointLocation", f"{self.out}/c").option("path", f"{self.out}/s").format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(states.schema).parquet(f"{self.out}/s")


def scan(run, hour, files, status="COMPLETED", **start):
    return [("START", run, hour, start), *(("SEEN", run, hour, {"path": p, "size": s}) for p, s in files.items()), ("FINISH", run, hour + 1, {"status": status})]


def test_restarts_give_what_the_batches_give(spark):
    rng, told = random.Random(3), Told(spark)
    known = spark.createDataFrame([], "relative_path string, size_bytes long, modified_at timestamp, presence_state string, missing_since_at timestamp, misses int")
    for i in range(5):
        files = {f"f{k}": rng.randint(1, 2) for k in range(8) if rng.random() < (0.9 if i < 2 else 0.45) and (k or i < 2)} | ({"f0": 1} if i < 2 else {})
        status = "COMPLETED" if i != 1 else "FAILED"
        told.batch(*scan(f"r{i}", 13 * i, files, status))
        found = told.run()  # a new start of the query for each scan
        seen = spark.createDataFrame([(p, s, None) for p, s in files.items()], "relative_path string, size_bytes long, modified_at timestamp")
        # null times differ by SQL's equality, so the batch operator is asked about presence and misses
        after = incremental.reconcile(known, seen, at(13 * i + 1), completed=status == "COMPLETED")
        known = spark.createDataFrame(after.drop("change_state").collect(), known.schema)
        want = {r["relative_path"]: (r["presence_state"], r["misses"], r["missing_since_at"]) for r in known.collect()}
        got = {r["relative_path"]: (r["presence_state"], r["misses"], r["missing_since_at"]) for r in scan_state.current_files(found).collect()}
        assert got == want
    assert {"PRESENT", "DELETED"} <= {p for p, *_ in got.values()}


def test_changes_leases_and_resumed_runs(spark):
    told = Told(spark)
    told.batch(*scan("r0", 0, {"a": 1, "b": 1}))
    told.batch(("START", "r1", 2, {"lease": 4}), ("SEEN", "r1", 2, {"path": "a", "size": 2}), ("START", "r2", 3, {}))  # r2 is refused while r1 has its lease
    told.batch(("SEEN", "r9", 6, {"path": "c", "size": 1}), ("SEEN", "r1", 6, {"path": "b", "size": 1}))  # nobody's, and a lease that has ended
    told.run()
    told.batch(("START", "r3", 7, {"resumed": "r0"}), ("START", "r4", 8, {"resumed": "r1"}), ("SEEN", "r4", 8, {"path": "a", "size": 2}), ("FINISH", "r4", 9, {"status": "COMPLETED"}), ("FINISH", "r4", 9, {"status": "COMPLETED"}))
    found = told.run()
    rows = {(r["run_id"], r["relative_path"], r["change_state"], r["finding"]) for r in found.collect()}
    assert {("r0", "a", "NEW", None), ("r1", "a", "MODIFIED", None), ("r4", "a", "UNCHANGED", None), ("r4", "b", "MISSING", None)} >= {r for r in rows if r[2] and r[1] in "ab" and r[0] != "r0"} - {("r1", "a", "UNCHANGED", None)}
    findings = {(r[0], r[3]) for r in rows if r[3]}
    assert {("r2", "RUN_REFUSED"), ("r9", "RUN_NOT_OWNED"), ("r1", "RUN_NOT_OWNED"), ("r3", "RESUME_REFUSED"), ("r4", "RUN_NOT_OWNED")} <= findings
    assert {r["relative_path"]: (r["presence_state"], r["misses"]) for r in scan_state.current_files(found).collect()} == {"a": ("PRESENT", 0), "b": ("MISSING", 1)}


def test_a_timer_ends_a_lease(spark):
    told = Told(spark)
    told.batch(("START", "r0", 0, {"lease": 1}), ("SEEN", "r0", 0, {"path": "a", "size": 1}))
    told.batch(("SEEN", "x", 5, {"path": "z", "size": 1}))
    told.batch(("SEEN", "x", 6, {"path": "z", "size": 1}))  # time has passed the lease by now
    found = told.run()
    assert {r["run_id"] for r in found.where("finding = 'LEASE_ENDED'").collect()} == {"r0"}
    assert found.where("finding = 'LEASE_ENDED'").count() == 3  # each bucket's


def test_lineage(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("f", "e"), (None, None)]
    got = {r["run_id"]: (r["first_run"], r["resumptions"]) for r in incremental.lineage(spark.createDataFrame(rows, "run_id string, resumed_from string")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("e", 0), "f": ("e", 1), None: (None, 0)}
    chain = spark.range(300).selectExpr("id AS run_id", "nullif(id - 1, -1) AS resumed_from")
    assert incremental.lineage(chain).where("first_run = 0 and resumptions = run_id").count() == 300
    with pytest.raises(ValueError):
        incremental.lineage(spark.createDataFrame([("a", "b"), ("b", "a")], "run_id string, resumed_from string"), rounds=4)
    assert incremental.lineage(chain.where("false")).count() == 0
