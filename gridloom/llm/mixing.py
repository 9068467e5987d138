"""Mixing sources to target weights, by repetition and a hash-seeded Bernoulli draw.

A source's tokens are summed, its target and so its repetition rate follow, and each
document is emitted floor(rate) times plus once more with probability rate - floor(rate).
The draw compares a number made from the MD5 of the document's id with the fraction,
so reruns agree. A hash parts each source's documents in two halves, and each half has
16 such seeds: of the 256 pairs the source takes the one whose sum is nearest its target,
which a single aggregation finds. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._shared import discard, stage, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 16


def draws(key: Column) -> list[Column]:
    """SEEDS numbers in [0, 2^32) as longs, fixed by the key: four from each of four MD5 sums."""
    out = []
    for j in range(SEEDS // 4):
        digest = F.md5(F.concat(key.cast("string"), F.lit(f":{j}")))
        out += [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    return out


def draw(key: Column, seed: Column) -> Column:
    """The number of draws(key) at `seed`, alone."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), F.floor(seed / 4).cast("string")))
    return F.conv(F.substring(digest, 8 * (seed % 4) + 1, F.lit(8)), 16, 10).cast("long")


def half(key: Column) -> Column:
    """0 or 1, fixed by the key."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":half"))), 1, 1), 16, 10).cast("int") % 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of every source of (source, size) rows.

    Sources in code-point order, null last, take the weights in turn and share the total; a target
    above cap times its source's size is cut to that and the excess reshared by weight. With
    sources ordered by size / weight the cut ones come first, so the common level is the first
    (total - what the cut ones take) / (weights of the others) that cuts no source more.
    The windows run in one task, over one row for each source, which partial sums leave: sources may be
    millions, but not as many as documents.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = sums.withColumn("w", turn.cast("long")).withColumn("full", F.col("source_size") * cap)
    by_level = one.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("full").over(before), F.lit(0))
    others = F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("level", left / others).withColumn("at", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("full"), F.struct("at", "level"))).over(one)
    rows = rows.withColumn("common", first["level"])
    target = F.when(F.col("common").isNull() | (F.col("common") * F.col("w") > F.col("full")), F.col("full").cast("double")).otherwise(F.col("common") * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def key_of(id_col: str, text_col: str) -> Column:
    """What a document's draws depend on: its id, or the text's hash where that is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text_col, F.lit("")))))


def doc_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, key of every row: all that the mix must know of a text, so words are counted once; staged."""
    return stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key_of(id_col, text_col).alias("key")), "mix-sizes")


def source_rates(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, whole (copies of every document), chance (of 2^32, for one more), seed (of both halves) of doc_sizes; staged."""
    targets = source_targets(light, weights, cap)
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    rates = targets.withColumn("whole", F.floor(rate)).withColumn("chance", ((rate - F.col("whole")) * F.lit(float(1 << 32))).cast("long"))
    rates = stage(rates, "mix-rates")
    same = light["source"].eqNullSafe(rates["source"])
    drawn = light.join(rates, same).select(rates["source"], "size", "chance", half(F.col("key")).alias("half"), *[d.alias(f"u{i}") for i, d in enumerate(draws(F.col("key")))])
    extra = [F.sum(F.when((F.col("half") == h) & (F.col(f"u{i}") < F.col("chance")), F.col("size")).otherwise(0)).alias(f"x{h}_{i}") for h in (0, 1) for i in range(SEEDS)]
    found = drawn.groupBy("source").agg(*extra).select(F.col("source").alias("of"), *[F.array(*[f"x{h}_{i}" for i in range(SEEDS)]).alias(f"x{h}") for h in (0, 1)])
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SEEDS * SEEDS - 1)), lambda n: F.struct(F.abs(F.get("x0", F.floor(n / SEEDS).cast("int")) + F.get("x1", n % SEEDS) - wanted).alias("off"), n.alias("seed")))
    chosen = rates.join(found, rates["source"].eqNullSafe(found["of"])).select("source", "source_size", "target", "whole", "chance", F.array_min(pairs)["seed"].alias("seed"))
    out = stage(chosen, "mix-seeds")
    discard(rates)
    return out


def copies(rows: DataFrame, rates: DataFrame, key: Column, source_col: str) -> DataFrame:
    """rows with __copies (and the columns of rates, prefixed __): how often the mix emits each."""
    own = rates.toDF(*[f"__{c}" for c in rates.columns])
    joined = rows.join(own, rows[source_col].eqNullSafe(own["__source"]), "left")
    seed = F.when(half(key) == 0, F.floor(F.col("__seed") / SEEDS).cast("int")).otherwise((F.col("__seed") % SEEDS).cast("int"))
    more = F.when(draw(key, seed) < F.col("__chance"), 1).otherwise(0)
    return joined.withColumn("__copies", (F.col("__whole") + more).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as its source's rate says.

    Null and empty texts weigh 0 and are emitted like the rest of their source; a source of
    weight 0 is not emitted; a null source is a source of its own; repeated rows draw alike;
    further columns are carried along (names that begin with two underscores are reserved).
    An empty table gives an empty one.
    """
    light = doc_sizes(docs, id_col, text_col, source_col)
    rates = source_rates(light, weights, cap)
    discard(light)
    counted = copies(docs, rates, key_of(id_col, text_col), source_col)
    emitted = counted.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return emitted.select(*[docs[c] for c in docs.columns])


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """id, size, source_size, target, copies, taken of every row: the mix without its texts.

    Nulls, empty texts, repeated rows, sources of weight 0 and empty tables: as mix() says.
    """
    light = doc_sizes(docs, id_col, text_col, source_col)
    counted = copies(light, source_rates(light, weights, cap), F.col("key"), "source")
    counted = counted.select(F.col("id").alias(id_col), "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))
    return counted.withColumn("taken", F.col("size") * F.col("copies"))
