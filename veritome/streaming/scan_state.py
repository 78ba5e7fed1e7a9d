"""Scans as a stream of marks with state that outlives the query: files by bucket, runs with leases and lineage.

A mark is START, SEEN or FINISH. Marks of runs go to every bucket, files to that of their path, so a run's end meets each
file once, in the bucket that holds it. A run that isn't finished when its lease ends is interrupted by a timer; only an
interrupted run can be resumed, and only what the running run says counts. Absence counts when a run completes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Parts of the state; about so many tasks take part, and each holds the files of a bucket while a run ends.
BUCKETS = 64
#: States told at a time; more are never held in Python.
TOLD = 20_000
# Misses and hours after which an absent file counts as deleted.
MISSES, HOURS = 3, 24
MARKS = "mark string, run_id string, relative_path string, size_bytes long, modified_at timestamp, resumed_from string, lease_expires_at timestamp, status string, at timestamp, sequence long"
STATES = "bucket int, sequence long, run_id string, relative_path string, change_state string, presence_state string, misses int, missing_since_at timestamp, recorded_at timestamp, finding string"
_FILE = "size_bytes long, modified_at timestamp, presence string, since timestamp, misses int, run string"
_RUN = "status string, parent string, expires timestamp"


def _time(x) -> pd.Timestamp | None:
    return None if x is None or pd.isna(x) else pd.Timestamp(x).tz_localize(None) if pd.Timestamp(x).tzinfo else pd.Timestamp(x)


def _text(x) -> str | None:
    return None if x is None or x is pd.NaT or (isinstance(x, float) and pd.isna(x)) else str(x)


class Scans(StatefulProcessor):
    """The state of one bucket; what a batch touches is read once and written once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", _FILE)
        self.runs = handle.getMapState("runs", "run string", _RUN)

    def _known_runs(self) -> dict[str, list]:
        return {k[0]: [v[0], v[1], _time(v[2])] for k, v in self.runs.iterator()}

    def _file(self, held: dict, path: str, whole: bool) -> list | None:
        if path not in held:
            held[path] = None
            if not whole and self.files.containsKey((path,)):
                v = self.files.getValue((path,))
                held[path] = [v[0], _time(v[1]), v[2], _time(v[3]), v[4], v[5]]
        return held[path]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (bucket,) = key
        marks = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        runs, held, changed, touched, out, present = self._known_runs(), {}, set(), set(), [], {}
        whole = not runs  # a bucket without a run has no files yet
        owner = next((r for r, v in runs.items() if v[0] == "RUNNING"), None)

        def told(m, path=None, change=None, finding=None) -> None:
            f = held[path] if path is not None and finding is None else None
            out.append((int(bucket), int(m.sequence), _text(m.run_id), path, change, f[2] if f else None, f[4] if f else None, f[3] if f else None, _time(m.at), finding))

        for m in marks.itertuples(index=False):
            run, at = _text(m.run_id), _time(m.at)
            if len(out) >= TOLD:
                yield _frame(out)
                out.clear()
            if owner and runs[owner][2] is not None and at is not None and at >= runs[owner][2]:
                out.append((int(bucket), None, owner, None, None, None, None, None, runs[owner][2], "LEASE_ENDED"))
                touched.add(owner)
                runs[owner][0], owner = "INTERRUPTED", None  # before its timer could tell
            if m.mark == "START":
                parent = _text(m.resumed_from)
                if owner or run in runs:
                    told(m, finding="RUN_REFUSED")
                elif parent is not None and runs.get(parent, [None])[0] != "INTERRUPTED":
                    told(m, finding="RESUME_REFUSED")
                else:
                    runs[run], owner = ["RUNNING", parent, _time(m.lease_expires_at)], run
                    touched.add(run)
                    if runs[run][2] is not None:
                        self.handle.registerTimer(int(runs[run][2].timestamp() * 1000))
            elif run != owner or run is None:
                told(m, _text(m.relative_path), finding="RUN_NOT_OWNED")
            elif m.mark == "SEEN":
                path, size, modified = _text(m.relative_path), None if pd.isna(m.size_bytes) else int(m.size_bytes), _time(m.modified_at)
                old = self._file(held, path, whole)
                change = "NEW" if old is None else "REAPPEARED" if old[2] != "PRESENT" else "UNCHANGED" if old[:2] == [size, modified] else "MODIFIED"
                held[path] = [size, modified, "PRESENT", None, 0, run]
                present[path] = held[path]
                changed.add(path)
                told(m, path, change)
            else:
                runs[run][0], owner = _text(m.status) or "COMPLETED", None
                touched.add(run)
                if runs[run][0] != "COMPLETED":
                    continue
                if not whole:
                    for k, v in self.files.iterator():
                        held.setdefault(k[0], [v[0], _time(v[1]), v[2], _time(v[3]), v[4], v[5]])
                    # what isn't deleted: a run's end passes over no others
                    present, whole = {p: f for p, f in held.items() if f and f[2] != "DELETED"}, True
                for path in sorted(p for p, f in present.items() if f[5] != run):
                    f = held[path]
                    f[3], f[4] = (f[3], f[4] + 1) if f[2] == "MISSING" and f[3] is not None else (at, 1)
                    f[2] = "DELETED" if f[4] >= MISSES and at >= f[3] + pd.Timedelta(hours=HOURS) else "MISSING"
                    if f[2] == "DELETED":
                        del present[path]
                    changed.add(path)
                    told(m, path, f[2])
        for run in touched:
            self.runs.updateValue((run,), tuple(runs[run]))
        for path in changed:
            self.files.updateValue((path,), tuple(held[path]))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), []
        for run, v in self._known_runs().items():
            if v[0] == "RUNNING" and v[2] is not None and v[2] <= now:
                self.runs.updateValue((run,), ("INTERRUPTED", v[1], v[2]))
                out.append((int(key[0]), None, run, None, None, None, None, None, v[2], "LEASE_ENDED"))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(out: list) -> pd.DataFrame:
    found = pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])
    for c in ("missing_since_at", "recorded_at"):
        found[c] = pd.to_datetime(found[c])
    return found.astype({"sequence": "Int64", "misses": "Int32", "bucket": "int32"})


def scan_states(marks: DataFrame, buckets: int = BUCKETS, late: str = "0 seconds") -> DataFrame:
    """The stream of STATES from a stream of MARKS: a row for each file seen or absent, and for each mark or lease with a finding.

    Marks are taken in order of ``sequence`` within a micro-batch. The state needs the RocksDB store (``rocksdb``).
    A null path is no file; repeated marks of a finished run are findings, so a source that tells a mark twice changes nothing.
    """
    own = F.when(F.col("mark") == "SEEN", F.array(F.pmod(F.xxhash64("relative_path"), F.lit(buckets)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))
    dealt = marks.where("mark <> 'SEEN' or relative_path is not null").withColumn("bucket", F.explode(own)).withWatermark("at", late)
    return dealt.groupBy("bucket").transformWithStateInPandas(Scans(), STATES, "Append", "EventTime")


def rocksdb(spark) -> None:
    """Makes the session keep states of streams that start from now on in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def current_files(states: DataFrame) -> DataFrame:
    """Each file's latest state from what the stream has written."""
    told = states.where("relative_path is not null and finding is null")
    last = told.groupBy("relative_path").agg(F.max_by(F.struct("presence_state", "misses", "missing_since_at", "change_state"), F.struct("sequence", "recorded_at")).alias("x"))
    return last.select("relative_path", "x.*")
