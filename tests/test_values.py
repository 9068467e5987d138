"""Queries without SQL against numpy on the same tables."""

import numpy as np
import pytest

import __spark_entry__ as entry
from gridloom.plans.registry import QUERIES

entry._reference()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    return rows, np.stack(rows["embedding"]).astype(float)


def test_pca_keeps_the_largest_variances(spark, embeddings):
    rows, x = embeddings
    got = QUERIES["C6_pca"](spark, SF).orderBy("vec_id").toPandas()
    assert got["vec_id"].tolist() == rows["vec_id"].tolist()
    p = np.stack(got["projection"])
    _, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs((p - p.mean(0)).T @ (p - p.mean(0))), np.diag(s[:4] ** 2), rtol=1e-6, atol=1e-6 * s[0] ** 2)
    # Signs of axes are arbitrary.
    assert np.allclose(np.abs(p), np.abs(x @ axes[:4].T), atol=1e-6)


def test_mlp_equals_plain_loops(spark, embeddings):
    rows, x = embeddings
    got = QUERIES["N5_A12_mlp"](spark, SF).orderBy("vec_id").toPandas()
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(64, 32)), rng.normal(size=(32, 8))
    for have, v in zip(got["out"][:50], x, strict=False):
        hidden = [max(0.0, sum(v[i] * a[i, j] for i in range(64))) for j in range(32)]
        out = [sum(hidden[i] * b[i, j] for i in range(32)) for j in range(8)]
        length = sum(o * o for o in out) ** 0.5 + 1e-6
        assert np.allclose(have, [o / length for o in out])
    assert len(got) == len(rows)


def test_patch_attention_equals_numpy(spark, embeddings):
    rows, x = embeddings
    at = dict(zip(rows["vec_id"], x, strict=True))
    got = QUERIES["W9_patch_attention"](spark, SF).toPandas()
    assert sorted(got["pos"]) == sorted(rows["vec_id"])
    for (label, _), part in got.groupby(["batch_id", "patch"]):
        assert len(part) <= 16
        v = np.stack([at[p] for p in part["pos"]])
        w = np.exp(v @ v.T * 0.125)
        assert np.allclose(np.stack(part["out"]), w / w.sum(1, keepdims=True) @ v)
        assert set(rows.set_index("vec_id").loc[part["pos"], "label"]) == {label}
