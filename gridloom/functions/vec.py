"""Array and geometry expressions: vectors, matrices, projections, encodings, bit codes. All run in the JVM."""

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(dbl(a), dbl(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(dbl(a), dbl(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column, eps: float = 1e-6) -> Column:
    """v / (|v| + eps); eps differs between callers."""
    return F.transform(dbl(v), lambda x: x / (norm(v) + F.lit(eps)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_error(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine(a, b)))


def relevancy(positive: Column, negative_max: Column, sharpness: float = 10.0) -> Column:
    """Least softmax share of the positive against each negative: the sigmoid against the strongest one."""
    return 1 / (1 + F.exp(-sharpness * (positive - negative_max)))


def determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def matvec(m: list[list[float]], v: list[Column]) -> list[Column]:
    return [sum((F.lit(float(row[j])) * v[j] for j in range(1, len(v))), F.lit(float(row[0])) * v[0]) for row in m]


def project(x: Column, y: Column, z: Column, extrinsic: list[list[float]], intrinsic: list[list[float]]) -> tuple[Column, Column, Column]:
    """Pixel column and row (truncated) and camera depth; null pixels where the depth is 0."""
    cam = matvec([r[:4] for r in extrinsic[:3]], [x, y, z, F.lit(1.0)])
    u, v, w = matvec(intrinsic, cam)
    return F.try_divide(u, w).cast("int"), F.try_divide(v, w).cast("int"), cam[2]


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion, normalised first."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.try_divide(c, n) for c in (w, x, y, z))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def matmul(a: Column, b: Column) -> Column:
    """Product of two array<array<double>> matrices."""
    cols = F.transform(F.sequence(F.lit(0), F.size(F.get(b, F.lit(0))) - 1), lambda j: F.transform(b, lambda r: F.get(r, j)))
    return F.transform(a, lambda r: F.transform(cols, lambda c: dot(r, c)))


def ray_point(origin: Column, direction: Column, depth: Column) -> Column:
    return origin + direction * depth


#: 1 / (2 sqrt(1/pi) / 2): the zeroth spherical-harmonic factor.
SH0 = 2 * sqrt(pi)


def rgb_to_sh(c: Column) -> Column:
    return (c - 0.5) * SH0


def sh_to_rgb(c: Column) -> Column:
    return c / SH0 + 0.5


def fourier(x: Column, bands: int, log_space: bool = True, highest: float = 10_000.0, width: int | None = None) -> Column:
    """sin and cos of x * f * pi for each band, f from 1 to highest / 2; zeros fill the left up to width."""
    top = highest / 2
    fs = [top ** (i / max(1, bands - 1)) if log_space else 1 + (top - 1) * i / max(1, bands - 1) for i in range(bands)]
    out = F.array(*[g(x * F.lit(f * pi)) for g in (F.sin, F.cos) for f in fs])
    return out if width is None else F.concat(F.array_repeat(F.lit(0.0), width - 2 * bands), out)


def position_code(axes: list[Column], extent: list[float], size: int) -> Column:
    """Fourier codes of all axes over their extents, one after the other, filled with zeros on the left to `size`."""
    bands = size // len(axes) // 2
    codes = F.concat(*[fourier(a / F.lit(float(e)), bands) for a, e in zip(axes, extent, strict=True)])
    return F.concat(F.array_repeat(F.lit(0.0), size - 2 * bands * len(axes)), codes)


def contract(p: Column) -> Column:
    """Contracted coordinate in [-2, 2] to [0, 1]."""
    return (p + 2) / 4


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def spread_bits(v: Column, bits: int = 21) -> Column:
    """Bit b of v moves to bit 3 b."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), b).bitwiseAND(1), 3 * b))
    return out


def morton(i: Column, j: Column, k: Column, bits: int = 21, offset: int = 0) -> Column:
    """Interleaved bits, i highest. Coordinates plus offset must lie in [0, 2^bits)."""
    spread = [spread_bits(c.cast("long") + offset, bits) for c in (i, j, k)]
    return F.shiftleft(spread[0], 2).bitwiseOR(F.shiftleft(spread[1], 1)).bitwiseOR(spread[2])


def unpack_label(v: Column) -> tuple[Column, Column]:
    """(semantic, instance) of an unsigned 32-bit label held as a long."""
    return v.bitwiseAND(0xFFFF), F.shiftrightunsigned(v, 16)


def pack_label(semantic: Column, instance: Column, wide: bool = False) -> Column:
    """An unsigned 32-bit label held as a long, as files hold it; wide keeps instances of more than 16 bits."""
    high = F.shiftleft(instance.cast("long"), 16)
    return semantic + (high if wide else high.bitwiseAND(0xFFFF0000))


def quaternion(m: Column) -> Column:
    """(w, x, y, z) with w >= 0 of a rotation matrix given as array<array<double>>: the top eigenvector
    of the symmetric 4 x 4 form, by numpy on Arrow batches.
    """
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            (a, b, c), (d, e, f), (g, h, i) = (list(x) for x in r)
            k = np.array([[a - e - i, 0, 0, 0], [d + b, e - a - i, 0, 0], [g + c, h + f, i - a - e, 0], [h - f, c - g, d - b, a + e + i]]) / 3.0
            _, v = np.linalg.eigh(k)
            q = v[[3, 0, 1, 2], -1]
            out.append((q if q[0] >= 0 else -q).tolist())
        return pd.Series(out)

    return run(m)


def rigid_inverse(m: Column) -> Column:
    """Inverse of a 4 x 4 rotation and translation: the transpose, and the translation turned back."""
    at = lambda r, c: F.get(F.get(m, F.lit(r)), F.lit(c))
    rows = [F.array(*[at(c, r) for c in range(3)], -(at(0, r) * at(0, 3) + at(1, r) * at(1, 3) + at(2, r) * at(2, 3))) for r in range(3)]
    return F.array(*rows, F.array(*[F.lit(float(v)) for v in (0, 0, 0, 1)]))


def instance_key(instance: Column) -> Column:
    """The id under which side files keep an instance: class 10 and the instance in the upper half."""
    return 10 + F.shiftleft(instance.cast("long"), 16).bitwiseAND(0xFFFF0000)


def palette(key: Column, seed: int = 0) -> Column:
    """A colour for each value: a hue from its hash, full saturation, as struct<r,g,b> in [0, 1]."""
    hue = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(360)) / 60.0
    channel = lambda shift: F.least(F.greatest(F.abs((hue + shift) % 6 - 3) - 1, F.lit(0.0)), F.lit(1.0))
    return F.struct(channel(0).alias("r"), channel(4).alias("g"), channel(2).alias("b"))
