"""Triangle meshes: boundary loops by list ranking, filling of gaps, smoothing. Tables: vid, x, y, z and fid, v0, v1, v2."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.order import global_rank
from gridloom.session import discard, stage

ENDS = (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))


def open_edges(faces: DataFrame) -> DataFrame:
    """a, b, copy: directed edges of faces that no face has the other way round, with their multiplicity. A vertex has as many that end as begin there."""
    edges = faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ENDS])).alias("e")).where("e.a <> e.b")
    way = F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1)
    net = edges.groupBy(F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi")).agg(F.sum(way).alias("net")).where("net <> 0")
    forth = F.col("net") > 0
    return net.select(F.when(forth, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(forth, F.col("hi")).otherwise(F.col("lo")).alias("b"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("net"))).alias("copy"))


def boundary_loops(faces: DataFrame) -> DataFrame:
    """loop, place, size, a, b of every open edge: loops are numbered by their least edge, places count from it along the edges.

    Where several open edges meet at a vertex, the n-th that ends there goes on as the n-th that begins there. Each edge knows the next; a
    round doubles how far it sees, with the least edge on the way and the steps to it, until all see around their loop: as
    many joins as the longest loop's length has binary digits.
    """
    edges = stage(open_edges(faces).select(F.struct("a", "b", "copy").alias("e"), "a", "b"), "open-edges")
    end = edges.withColumn("turn", F.row_number().over(W.partitionBy("b").orderBy("e"))).select("e", F.col("b").alias("at"), "turn")
    begin = edges.withColumn("turn", F.row_number().over(W.partitionBy("a").orderBy("e"))).select(F.col("e").alias("to"), F.col("a").alias("at"), "turn")
    seen = stage(end.join(begin, ["at", "turn"]).select("e", "to", F.col("e").alias("low"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("moved")), "loop-links")
    reach = 1
    while seen.where("moved").limit(1).count():
        ahead = seen.select(F.col("e").alias("at"), F.col("to").alias("far"), F.col("low").alias("less"), F.col("off").alias("more"))
        lower = F.col("less") < F.col("low")
        new = seen.join(ahead, seen["to"] == ahead["at"]).select("e", F.col("far").alias("to"), F.least("low", "less").alias("low"), F.when(lower, F.col("more") + reach).otherwise(F.col("off")).alias("off"), lower.alias("moved"))
        new = stage(new, "loop-links")
        discard(seen)
        seen, reach = new, 2 * reach
    sizes = global_rank(seen.groupBy("low").agg(F.count("*").alias("size")), ["low"], "loop").withColumnRenamed("low", "least")
    whole = seen.join(sizes, seen["low"] == sizes["least"])
    return whole.select("loop", ((F.col("size") - F.col("off")) % F.col("size")).alias("place"), "size", F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def _cotangent(corner: list[Column], p: list[Column], q: list[Column]) -> Column:
    """Cotangent of the angle at a corner between two points; null for a flat triangle."""
    u, v = [a - c for a, c in zip(p, corner, strict=True)], [a - c for a, c in zip(q, corner, strict=True)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.try_divide(u[0] * v[0] + u[1] * v[1] + u[2] * v[2], F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]))


def fill_gaps(vertices: DataFrame, faces: DataFrame, harmonic: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces with a fan for every boundary loop of three or more edges around a new vertex; old rows are as they were.

    The new vertex begins at the mean of the loop. If harmonic it moves to where the surface of the fan is in balance: its neighbours, which
    stay, weighted by the cotangents of the angles that face the edge to them; it stays where these are not finite, or do not sum to more than 0. Fans turn like
    the faces around them.
    """
    loops = stage(boundary_loops(faces).where("size >= 3"), "loops")
    at = vertices.select("vid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    rims = loops
    for end in "ab":
        rims = rims.join(at.select(F.col("vid").alias(end), *[F.col(c).alias(f"{c}{end}") for c in "xyz"]), end)
    rims = stage(rims, "loop-rims")
    base = vertices.agg(F.coalesce(F.max("vid"), F.lit(-1)).alias("last_v")), faces.agg(F.coalesce(F.max("fid"), F.lit(-1)).alias("last_f"))
    centres = stage(rims.groupBy("loop").agg(*[F.avg(f"{c}a").alias(c) for c in "xyz"]), "loop-centres")
    if harmonic:
        own = rims.join(centres, "loop")
        c, a, b = [[F.col(f"{x}{end}") for x in "xyz"] for end in ("", "a", "b")]
        weighed = own.select("loop", F.explode(F.array(F.struct(_cotangent(b, c, a).alias("w"), *[F.col(f"{x}a").alias(x) for x in "xyz"]), F.struct(_cotangent(a, c, b).alias("w"), *[F.col(f"{x}b").alias(x) for x in "xyz"]))).alias("n"))
        sums = weighed.groupBy("loop").agg(F.count_if(F.col("n.w").isNull() | F.isnan("n.w")).alias("odd"), F.sum("n.w").alias("w"), *[F.sum(F.col("n.w") * F.col(f"n.{x}")).alias(f"s{x}") for x in "xyz"])
        fair = (F.col("odd") == 0) & (F.col("w") > 1e-12)
        centres = centres.join(sums, "loop").select("loop", *[F.when(fair, F.col(f"s{x}") / F.col("w")).otherwise(F.col(x)).alias(x) for x in "xyz"])
    numbered = global_rank(centres, ["loop"], "n").join(F.broadcast(base[0])).withColumn("cap", F.col("last_v") + 1 + F.col("n"))  # one row
    numbered = stage(numbered, "loop-caps")
    fans = global_rank(loops.select("loop", "place", "a", "b").join(numbered.select("loop", "cap"), "loop"), ["loop", "place"], "n").join(F.broadcast(base[1]))  # one row
    kind, face = dict(vertices.dtypes), dict(faces.dtypes)
    more_v = numbered.select(F.col("cap").cast(kind["vid"]).alias("vid"), *[F.col(x).cast(kind[x]).alias(x) for x in "xyz"])
    more_f = fans.select((F.col("last_f") + 1 + F.col("n")).cast(face["fid"]).alias("fid"), F.col("cap").cast(face["v0"]).alias("v0"), F.col("b").cast(face["v1"]).alias("v1"), F.col("a").cast(face["v2"]).alias("v2"))
    return vertices.unionByName(more_v, allowMissingColumns=True), faces.unionByName(more_f, allowMissingColumns=True)


def smooth(vertices: DataFrame, faces: DataFrame, rounds: int = 1, step: float = 0.5, fixed: DataFrame | None = None) -> DataFrame:
    """Vertices moved `step` of the way to the mean of their neighbours, `rounds` times; vertices in fixed (vid), and those of no face, stay."""
    ways = faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for p in ENDS for a, b in (p, p[::-1])])).alias("e")).where("e.a <> e.b").select("e.a", "e.b").distinct()
    if fixed is not None:
        ways = ways.join(fixed.select(F.col("vid").alias("a")), "a", "left_anti")
    ways = stage(ways, "smooth-edges")
    for _ in range(rounds):
        means = ways.join(vertices.select(F.col("vid").alias("b"), "x", "y", "z"), "b").groupBy("a").agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"])
        moved = vertices.join(means, vertices["vid"] == means["a"], "left")
        vertices = stage(moved.select(*[(F.col(c) + F.lit(float(step)) * (F.coalesce(f"mean_{c}", c) - F.col(c))).alias(c) if c in "xyz" else F.col(c) for c in vertices.columns]), "smooth")
    return vertices
