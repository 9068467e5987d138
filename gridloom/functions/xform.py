"""Coordinate transforms as plan-time values that emit column expressions."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Xform(ABC):
    """A transform of each axis. `a @ b` is "b first, then a"; `a @ df` transforms columns x, y, z."""

    @abstractmethod
    def axis(self, c: Column) -> Column: ...

    @abstractmethod
    def inverse(self) -> Xform: ...

    @property
    def invertible(self) -> bool:
        return True

    def then(self, after: Xform) -> Xform:
        return chain(self, after)

    def apply(self, df: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
        return df.withColumns({a: self.axis(F.col(a)) for a in axes})

    def bounds(self, lo: Column, hi: Column) -> tuple[Column, Column]:
        """Per-axis transforms map boxes to boxes: the corners' least and greatest."""
        a, b = self.axis(lo), self.axis(hi)
        return F.least(a, b), F.greatest(a, b)

    def pseudo_scale(self) -> float:
        """|T(1,1,1) - T(0,0,0)| / sqrt 3; for per-axis maps the size of the slope."""
        return abs(self.at(1.0) - self.at(0.0))

    @abstractmethod
    def at(self, x: float) -> float: ...

    def __matmul__(self, other):
        if isinstance(other, Xform):
            return other.then(self)
        if isinstance(other, DataFrame):
            return self.apply(other)
        if isinstance(other, Column):
            return self.axis(other)
        return NotImplemented


@dataclass(frozen=True)
class Identity(Xform):
    def axis(self, c):
        return c

    def at(self, x):
        return x

    def inverse(self):
        return self


@dataclass(frozen=True)
class Affine(Xform):
    """x * scale + shift on all axes; a zero scale is an error."""

    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        if self.scale == 0:
            raise ValueError("scale must not be zero")

    def axis(self, c):
        return c * F.lit(float(self.scale)) + F.lit(float(self.shift))

    def at(self, x):
        return x * self.scale + self.shift

    def inverse(self):
        return Affine(1.0 / self.scale, -self.shift / self.scale)


@dataclass(frozen=True)
class Chain(Xform):
    parts: tuple[Xform, ...]

    def axis(self, c):
        for p in self.parts:
            c = p.axis(c)
        return c

    def at(self, x):
        for p in self.parts:
            x = p.at(x)
        return x

    @property
    def invertible(self):
        return all(p.invertible for p in self.parts)

    def inverse(self):
        return chain(*(p.inverse() for p in reversed(self.parts)))


def chain(*parts: Xform) -> Xform:
    """Flatten, drop identities and fuse neighbouring affine maps (Catalyst does not fuse float arithmetic)."""
    flat: list[Xform] = []
    for p in parts:
        for q in p.parts if isinstance(p, Chain) else (p,):
            if isinstance(q, Identity):
                continue
            if isinstance(q, Affine) and flat and isinstance(flat[-1], Affine):
                last = flat.pop()
                q = Affine(last.scale * q.scale, last.shift * q.scale + q.shift)
            flat.append(q)
    return flat[0] if len(flat) == 1 else Chain(tuple(flat)) if flat else Identity()


def voxel_to_world(size: float) -> Affine:
    """Voxel index to the world position of its centre."""
    return Affine(size, 0.5 * size)


def world_to_voxel(size: float) -> Affine:
    """World position to corner-aligned voxel coordinates."""
    return Affine(1.0 / size, 0.0)


def coarse_to_fine(factor: int) -> Affine:
    """Coarse voxel index to the fine index at its centre: f * i + (f - 1) / 2."""
    return Affine(float(factor), (factor - 1) / 2)
