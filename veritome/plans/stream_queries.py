"""Streams that run over the driver's tables until they are read, with DuckDB oracles of what they leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.operators import incremental
from veritome.plans.registry import query, table
from veritome.sources.shared import new_path
from veritome.streaming import scan_state

#: Events in a scan of the role-play below: an event a minute, a scan of eight hours.
WIDTH = 500
#: Events of a bucket: a task holds those of one at a time.
HELD = 150_000


def _marks(events):
    """Events as files that scans see: every WIDTH events begin and end a run; every fifth run fails."""
    i = F.col("event_id")
    run, at = F.floor(i / WIDTH), F.timestamp_seconds(i * 60)
    name = F.concat(F.lit("r"), run.cast("string"))
    none = F.lit(None)

    def mark(kind: str, place: int, seen: bool):
        status = F.when(run % 5 == 4, "FAILED").otherwise("COMPLETED")
        return F.struct(
            F.lit(kind).alias("mark"), name.alias("run_id"), (F.concat(F.lit("u"), F.col("user_id").cast("string")) if seen else none.cast("string")).alias("relative_path"), (F.floor(F.col("value")) if seen else none).cast("long").alias("size_bytes"), none.cast("timestamp").alias("modified_at"),
            none.cast("string").alias("resumed_from"), none.cast("timestamp").alias("lease_expires_at"), status.alias("status"), at.alias("at"), (i * 3 + place).alias("sequence"),
        )

    every = F.array(F.when(i % WIDTH == 0, mark("START", 0, False)), mark("SEEN", 1, True), F.when(i % WIDTH == WIDTH - 1, mark("FINISH", 2, False)))
    return events.select(F.explode(F.array_compact(every)).alias("m")).select("m.*")


@query(f"""WITH e AS (SELECT *, event_id // {WIDTH} AS run FROM events), full_runs AS (SELECT run FROM e GROUP BY run HAVING count(*) FILTER (event_id % {WIDTH} = 0) > 0),
done AS (SELECT run, event_id * 60 AS t FROM e WHERE event_id % {WIDTH} = {WIDTH - 1} AND run % 5 <> 4 AND run IN (SELECT run FROM full_runs)),
seen AS (SELECT user_id, max(run) AS last FROM e WHERE run IN (SELECT run FROM full_runs) GROUP BY 1),
gone AS (SELECT user_id, d.run, d.t, row_number() OVER (PARTITION BY user_id ORDER BY d.run) AS n, min(d.t) OVER (PARTITION BY user_id) AS since FROM seen JOIN done d ON d.run > seen.last),
dead AS (SELECT user_id, min(n) AS n FROM gone WHERE n >= 3 AND t >= since + 24 * 3600 GROUP BY 1), miss AS (SELECT user_id, max(n) AS n FROM gone GROUP BY 1)
SELECT 'u' || cast(user_id AS VARCHAR) AS relative_path, CASE WHEN dead.n IS NOT NULL THEN 'DELETED' WHEN miss.n IS NOT NULL THEN 'MISSING' ELSE 'PRESENT' END AS presence_state, cast(coalesce(dead.n, miss.n, 0) AS INTEGER) AS misses FROM seen LEFT JOIN dead USING (user_id) LEFT JOIN miss USING (user_id)""")
def scan_stream(spark, d):
    """State across runs by a stream over all events."""
    events = table(spark, d, "events")
    scan_state.rocksdb(spark)
    out = new_path(spark, "stream")
    read = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    states = scan_state.scan_states(_marks(read), buckets=max(8, -(-events.count() // HELD)))
    states.writeStream.option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/states").format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return scan_state.current_files(spark.read.schema(states.schema).parquet(f"{out}/states")).select("relative_path", "presence_state", "misses")


@query("""WITH RECURSIVE runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 END AS resumed_from FROM orders),
way AS (SELECT run_id, run_id AS place, 0 AS n FROM runs UNION ALL SELECT way.run_id, r.resumed_from, n + 1 FROM way JOIN runs r ON r.run_id = way.place JOIN runs p ON p.run_id = r.resumed_from)
SELECT run_id, arg_max(place, n) AS first_run, cast(max(n) AS BIGINT) AS resumptions FROM way GROUP BY run_id""")
def run_lineage(spark, d):
    k = F.col("o_orderkey")
    return incremental.lineage(table(spark, d, "orders").select(k.alias("run_id"), F.when(k % 7 != 0, k - 1).alias("resumed_from")))
