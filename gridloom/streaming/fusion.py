"""Streaming forms: incremental cell fusion, progress as metrics, and windowed event rollups."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridloom.operators.voxel import KEY

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fuse_stream(samples: DataFrame, values: list[str], weight: str, path: str, checkpoint: str, trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Weighted sums of each cell as frames arrive; read the result with fused().

    The sums of a cell are the state, kept by Spark's state store (on disk, RocksDB) and not by the driver. A
    batch writes the cells that it changed, with their new sums, to its own folder below path, which a
    repeated batch overwrites; so a query that is stopped and started again with the same checkpoint goes on
    where it was. Sums are commutative: frames may come late and in any order.
    """
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    sums = samples.groupBy(*KEY).agg(F.sum(weight).alias("weight"), *[F.sum(F.col(weight) * F.col(v)).alias(v) for v in values])

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(**trigger) if trigger else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The sums of each cell as its last batch wrote them."""
    rows = spark.read.parquet(path)
    sums = [c for c in rows.columns if c not in (*KEY, "batch")]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*sums), "batch").alias("s")).select(*KEY, "s.*")


def fused(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    """The grid as voxel.fuse makes it of all samples so far: cells with weight, and weighted means."""
    return latest(spark, path).where("weight > 0").select(*KEY, "weight", *[(F.col(v) / F.col("weight")).alias(v) for v in values])


class ProgressLog(StreamingQueryListener):
    """Progress of streaming queries as rows (run, query, step, name, value): a JSON line for each number of a batch.

    Register with spark.streams.addListener. Rows gather in memory until flush() writes them; at most `most`, then it writes by itself.
    """

    NUMBERS = ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "batchDuration")

    def __init__(self, spark: SparkSession, path: str, most: int = 1000):
        self.spark, self.path, self.most, self.rows = spark, path, most, []

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.runId), event.name, -1, "started", 1.0))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        found = {n: p[n] for n in self.NUMBERS if n in p}
        for state in p.get("stateOperators", []):
            found |= {f"state{n[3:]}": state[n] for n in ("numRowsTotal", "numRowsUpdated") if n in state}
        self.rows += [(p["runId"], p.get("name"), p["batchId"], n, float(v)) for n, v in found.items()]
        if len(self.rows) >= self.most:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.append((str(event.runId), None, -1, "failed" if event.exception else "ended", 1.0))

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, "run string, query string, step long, name string, value double").coalesce(1).write.mode("append").parquet(self.path)


def tumbling(events: DataFrame, width: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts and sums of each kind of event in fixed windows; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
