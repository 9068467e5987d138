"""Table functions for SQL and lateral joins: rays through cells, and blending of ordered rows."""

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="i long, j long, k long, enter double, leave double")
class WalkCells:
    """walk_cells(ox, oy, oz, dx, dy, dz, size, near, far): the cells that a ray meets between two distances, in order, each with where it is entered and left.

    Distances count in lengths of the direction. Exact traversal: one step for each cell face crossed; at an edge or corner one axis
    after the other (x before y before z). Nulls, numbers that are not finite and directions of length 0 give no rows.
    """

    def eval(self, ox, oy, oz, dx, dy, dz, size, near, far):
        given = (ox, oy, oz, dx, dy, dz, size, near, far)
        if any(v is None or not math.isfinite(v) for v in given) or size <= 0 or near > far or not (dx or dy or dz):
            return
        start, way = (ox, oy, oz), (dx, dy, dz)
        at = [math.floor((o + near * d) / size) for o, d in zip(start, way, strict=True)]
        step = [(d > 0) - (d < 0) for d in way]

        def crossing(axis: int) -> float:
            """Where the ray leaves its present cell along an axis."""
            if not step[axis]:
                return math.inf
            return ((at[axis] + (step[axis] > 0)) * size - start[axis]) / way[axis]

        enter, turn = near, [crossing(a) for a in range(3)]
        while True:
            axis = min(range(3), key=turn.__getitem__)
            leave = min(max(turn[axis], enter), far)
            yield at[0], at[1], at[2], enter, leave
            if turn[axis] >= far:
                return
            at[axis] += step[axis]
            enter, turn[axis] = leave, crossing(axis)


@udtf(returnType="sid long, place int, weight double")
class Blend:
    """blend(TABLE(rows: sid, alpha) PARTITION BY pixel ORDER BY depth, sid [, cut]): weights from front to back; stops where no more than cut of the light is left."""

    def __init__(self):
        self.left, self.place, self.done = 1.0, 0, False

    def eval(self, row, cut=1e-4):
        if self.done or row["alpha"] is None:
            return
        after = self.left * (1 - row["alpha"])
        if after <= cut:
            self.done = True
            return
        yield row["sid"], self.place, row["alpha"] * self.left
        self.left, self.place = after, self.place + 1


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: walk_cells and blend."""
    spark.udtf.register("walk_cells", WalkCells)
    spark.udtf.register("blend", Blend)
