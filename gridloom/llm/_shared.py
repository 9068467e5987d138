"""Helpers that the operators of this subpackage share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where a local session names none (tests) is a temporary folder chosen; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def stage(df: DataFrame, name: str, arrow_rows: int | None = None, spread: bool = False, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor costs no more than one stage) and gives the
    planner the table's true size, so that it broadcasts only what is small and
    can split skewed partitions of a join that follows. arrow_rows bounds the
    batches that go to Python while this table is made: texts in batches of
    10,000 rows, the default, hold much memory outside the heap. spread keeps
    small shuffle partitions apart, where few bytes mean much work. codec: a compression other than the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {}) | ({COALESCE: "false"} if spread else {})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path, compression=codec)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/gridloom/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty. Runs in the JVM."""
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    # Splitting yields an empty first or last piece where the text begins or ends with white space.
    edge = lambda pattern: F.when(text.rlike(pattern), 1).otherwise(0)
    n = pieces - edge(r"^[\x20\x09-\x0D]") - edge(r"[\x20\x09-\x0D]\z")
    return F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(n).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_in_group(df: DataFrame, group: list[str], order: list[str], name: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add column `name`: 0, 1, ... within each group in a fixed pseudo-random order.

    The ordering columns are hashed into buckets whose number grows with the rows,
    each bucket is ranked alone, and the counts of earlier buckets are added. So no
    task gets a whole group. Rows that agree in all ordering columns are
    interchangeable. df should be a staged table, as it is read twice.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    g = [F.col(c) for c in group]
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*g, "__bucket").count()
    from pyspark.sql import Window as W

    before = F.sum("count").over(W.partitionBy(*g).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = stage(counts.select(*g, "__bucket", F.coalesce(before, F.lit(0)).alias("__before")), "rank-offsets")
    inner = F.row_number().over(W.partitionBy(*g, "__bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("__inner", inner)
    same = [ranked[c].eqNullSafe(offsets[c]) for c in [*group, "__bucket"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    # One row for each bucket of 50,000 rows: far smaller than df; the planner knows its size.
    joined = ranked.join(offsets, cond)
    return joined.select(*[ranked[c] for c in df.columns], (F.col("__inner") + F.col("__before")).cast("long").alias(name))
