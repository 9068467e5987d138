"""Draws and codes of queries without SQL, made again outside Spark: hashes by the xxhash library, order statistics and nearest centres by numpy."""

import math
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from gridloom.operators import vector
from gridloom.plans.inputs import points
from gridloom.plans.registry import QUERIES

entry._reference()
SF = "/root/testdata/sf0.001"


def chained(*values):
    """Spark's xxhash64 of (value, "i" or "q") columns: each hashes with the one before as its seed."""
    h = 42
    for value, kind in values:
        h = xxhash.xxh64(struct.pack(f"<{kind}", value), seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def unit(*values):
    return chained(*values) % (1 << 53) / (1 << 53)


@pytest.fixture(scope="module")
def rows(spark):
    return points(spark, SF).select("mask_id", "pid", "z").collect()


def test_draws_with_replacement(spark, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.mask_id].append(r.pid)
    want = {(g, n): sorted(ids)[int(unit((g, "i"), (n, "i"), (0, "i")) * len(ids))] for g, ids in groups.items() for n in range(256)}
    got = {(r.mask_id, r.draw): r.pid for r in QUERIES["M1_with_replacement"](spark, SF).collect()}
    assert got == want and len(want) == 256 * len(groups)


def test_importance_sample(spark, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.mask_id].append((r.pid, r.z if r.z > 0 else None))
    want = set()
    for g, members in groups.items():
        known = sorted(z for _, z in members if z is not None)
        middle = known[math.ceil(len(known) / 2) - 1]
        draws = sorted((-math.log(max(unit((pid, "q"), (0, "i")), 1e-300)) * (middle if z is None else z), pid) for pid, z in members)
        want |= {(g, pid) for _, pid in draws[:256]}
    assert {tuple(r) for r in QUERIES["M2_importance_sample"](spark, SF).collect()} == want


def test_order_of_an_epoch(spark, rows):
    got = {r.pid: r.order for r in QUERIES["M5_epoch_order"](spark, SF).collect()}
    assert got == {r.pid: chained((r.pid, "q"), (10, "i")) for r in rows}


def test_residual_codes_are_the_nearest_centres(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = e.orderBy("vec_id").toPandas()
    left = np.stack(table["embedding"]).astype(float)
    got = {r.vec_id: list(r.codes) for r in QUERIES["C9_residual_codes"](spark, SF).collect()}
    for level in range(2):
        frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(table["vec_id"], left, strict=True)], "vec_id long, residual array<double>")
        book = np.array([c for _, c in vector.fit_codebook(frame.orderBy("vec_id").coalesce(1), 8, "residual", level)])
        own = np.array([got[i][level] for i in table["vec_id"]])
        # k-means of other partitions may number or place its centres otherwise: a code is right if its group's mean is its centre and each row is nearest to its own.
        centres = np.stack([left[own == c].mean(0) if (own == c).any() else np.full(left.shape[1], 9.0) for c in range(8)])
        d = np.linalg.norm(left[:, None] - centres[None], axis=2)
        assert (d[np.arange(len(left)), own] <= d.min(1) + 0.05).mean() > 0.97
        assert np.square(d[np.arange(len(left)), own]).sum() <= 1.1 * np.square(np.linalg.norm(left[:, None] - book[None], axis=2).min(1)).sum()
        left = left - centres[own]
