"""Radius and nearest-neighbour joins by grid buckets, and what is built on them."""

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.vec import finite
from gridloom.session import discard, stage

AXES = ("x", "y", "z")


def _cell(df: DataFrame, prefix: str, width: float) -> DataFrame:
    return df.withColumns({f"{prefix}{a}": F.floor(F.col(a) / F.lit(width)).cast("long") for a in AXES})


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) * (F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) for c in AXES[1:]), (F.col(f"{a}_x") - F.col(f"{b}_x")) * (F.col(f"{a}_x") - F.col(f"{b}_x"))))


def radius_join(left: DataFrame, right: DataFrame, radius: float, pid: str = "pid", carried: list[str] | None = None, spread: str | None = None) -> DataFrame:
    """Pairs closer than radius: cells as wide as the radius, one side sent to its 27 cells, an equi-join, then the test.

    spread names the side that is sent, "left" or "right"; unless it is given both are counted, and the one of fewer rows is sent.
    """
    if spread is None:
        spread = "left" if left.count() < right.count() else "right"
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]))

    def side(df: DataFrame, name: str, more: list[str], sent: bool) -> DataFrame:
        df = _cell(df, "c", radius)
        if sent:
            df = df.withColumn("d", around).withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"d.d{c}") for c in AXES})
        return df.select("cx", "cy", "cz", F.col(pid).alias(f"{name}_id"), *[F.col(c).cast("double").alias(f"{name}_{c}") for c in AXES], *[F.col(c).alias(f"{name}_{c}") for c in more])

    # The planner takes a side that is sent for as small as its file; it must not broadcast it.
    pairs = side(left, "a", [], spread == "left").join(side(right, "b", carried or [], spread != "left").hint("merge"), ["cx", "cy", "cz"])
    return pairs.withColumn("distance", _distance("a", "b")).where(F.col("distance") < radius).drop("cx", "cy", "cz")


def fitting_width(points: DataFrame, width: float, k: int = 1, pairs: float = 2e7) -> float:
    """width, halved until a cell would hold few more than k points (or so many that all cells make `pairs` pairs) if they were spread evenly in their box: so work grows with the points.

    A box may be thin: of its volume, its largest face and its longest side, what asks for the widest cells counts.
    """
    axes = [F.col(a).cast("double") for a in AXES]
    box = points.where(finite(*axes)).agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(a) for a, c in zip(AXES, axes, strict=True)]).first()
    sides, width = sorted((box[a] for a in AXES if box[a]), reverse=True), float(width)
    share = max((k + 2) / 2, pairs / 27 / max(1, box.n)) / max(1, box.n)
    fit = max(((prod(sides[:n]) * share) ** (1 / n) for n in range(1, len(sides) + 1)), default=width)
    while 0 < fit < width:
        width /= 2
    return width


def nearest(left: DataFrame, right: DataFrame, width: float, pid: str = "pid", carried: list[str] | None = None, k: int = 1) -> DataFrame:
    """The k nearest right rows of each left row, exact: a_id, rank, b_id, distance and the carried columns.

    Rounds with cells of doubled width: a left row is done when k rows are nearer than the width of that
    round's cells, since all rows that near are then among the 27 cells. Rounds end as the cells come to
    span the points; rows that are not finite have no neighbours. The k best are kept by rank,
    which Spark limits on each partition before it shuffles. Of right rows in one place only the k of least id
    can be among the nearest, left rows in one place have the same, and the first width is no more than their density asks for.
    """
    carried = carried or []
    ok = finite(*[F.col(a).cast("double") for a in AXES])
    place = W.partitionBy(*[F.col(a).cast("double") + F.lit(0.0) for a in AXES]).orderBy(pid)
    kept = right.where(ok).withColumn("__nth", F.row_number().over(place)).where(F.col("__nth") <= k)
    right = stage(kept.select(pid, *[a for a in AXES], *[c for c in carried if c not in (pid, *AXES)], "__nth"), "nearest-right")
    asked = stage(left.where(ok).select(F.col(pid).alias("__id"), *[(F.col(a).cast("double") + F.lit(0.0)).alias(a) for a in AXES]), "nearest-left")
    todo = stage(asked.groupBy(*AXES).agg(F.min("__id").alias(pid)), "nearest-todo")
    radius = fitting_width(right.where("__nth = 1"), width, k)
    rows, open_ = right.count(), todo.count()
    enough, done = min(k, rows), []
    at_a = W.partitionBy("a_id")
    while True:
        met = radius_join(todo, right, radius, pid, carried, "left" if open_ < rows else "right")
        top = met.withColumn("rank", F.row_number().over(at_a.orderBy("distance", "b_id"))).where(F.col("rank") <= k)
        whole = top.withColumn("__n", F.count("*").over(at_a)).where(F.col("__n") >= enough)
        found = stage(whole.select(*[F.col(f"a_{a}").alias(f"__{a}") for a in AXES], "a_id", (F.col("rank") - 1).alias("rank"), "b_id", "distance", *[F.col(f"b_{c}").alias(c) for c in carried]), "nearest")
        done.append(found.drop("a_id"))
        if not enough or not open_:
            break
        rest = stage(todo.join(found.where("rank = 0").select("a_id"), todo[pid] == F.col("a_id"), "left_anti"), "nearest-todo")
        discard(todo)
        todo, open_ = rest, rest.count()
        if not open_:
            break
        radius *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    here = asked.select(F.col("__id").alias("a_id"), *[F.col(a).alias(f"__{a}") for a in AXES])
    return here.join(out, [f"__{a}" for a in AXES]).select("a_id", "rank", "b_id", "distance", *carried)


def nearest_within(left: DataFrame, right: DataFrame, bound: float, pid: str = "pid") -> DataFrame:
    """Distance to the nearest right row below the bound, infinity where there is none."""
    best = radius_join(left, right, bound, pid, spread="left" if left.count() < right.count() else "right").groupBy("a_id").agg(F.min("distance").alias("distance"))
    return left.join(best, left[pid] == best["a_id"], "left").select(pid, F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def propagate_labels(sample: DataFrame, everything: DataFrame, width: float, label: str = "label", pid: str = "pid") -> DataFrame:
    """Each row with the label of its nearest labelled row (label >= 0)."""
    got = nearest(everything, sample.where(F.col(label) >= 0), width, pid, [label])
    return got.select(F.col("a_id").alias(pid), label, "distance")


def reproject(targets: DataFrame, sources: DataFrame, width: float, values: list[str], pid: str = "pid") -> DataFrame:
    """Values of the nearest source; targets that are not finite get the mean of all sources."""
    ok = finite(*[F.col(a) for a in AXES])
    got = nearest(targets.where(ok), sources, width, pid, values).select(F.col("a_id").alias(pid), *values)
    means = sources.agg(*[F.avg(v).alias(v) for v in values])
    return got.unionByName(targets.where(~ok).select(pid).join(F.broadcast(means)))  # one row


def nearest_to_click(points: DataFrame, at: tuple[float, float, float], k: int = 10, pid: str = "pid") -> DataFrame:
    d = F.sqrt(sum(((F.col(a) - F.lit(float(c))) * (F.col(a) - F.lit(float(c))) for a, c in zip(AXES, at, strict=True)), F.lit(0.0)))
    return points.withColumn("distance", d).orderBy("distance", pid).limit(k)
