import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions.levels import hadamard_matrix, lloyd_levels, qr_rotation, stored_codebook
from vectorloom.operators import quantize as Q
from vectorloom.operators.tables import decode, dense_model


def _model(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))],
                               "row_id bigint, embedding array<double>")
    return dense_model(df, x.shape[1], len(x), ["t"])


def _arr(df, col):
    return np.array([r[col] for r in df.orderBy("row_id").collect()], dtype=float)


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(7).standard_normal((40, 16))


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_uniform_matches_numpy(spark, x, bits):
    m = Q.quantize(_model(spark, x), bits, "uniform")
    q = (1 << (bits - 1)) - 1
    scale = np.maximum(np.abs(x).max(1, keepdims=True), 1e-8)
    want = np.clip(np.rint(x / scale * q), -q - 1, q)
    assert (_arr(m.weights, "codes") == want).all()
    assert m.provenance[-1] == f"int{bits}"


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_codebook_matches_argmin(spark, x, bits):
    m = Q.quantize_codebook(_model(spark, x), bits)
    lv = np.array(lloyd_levels(bits))
    z = x / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(16)
    want = np.abs(z[:, :, None] - lv[None, None, :]).argmin(-1)
    assert (_arr(m.weights, "codes") == want).all()
    dec = _arr(decode(m), "embedding")
    cb = np.array(stored_codebook(bits, 16))
    assert np.allclose(dec, np.linalg.norm(x, axis=1, keepdims=True) * cb[want])


@pytest.mark.parametrize("mat", [hadamard_matrix, qr_rotation])
def test_rotations_orthogonal(spark, x, mat):
    r = mat(16)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-12)
    rot = _arr(Q.rotate_hadamard(_model(spark, x).weights, 16) if mat is hadamard_matrix
               else Q.rotate_qr(_model(spark, x).weights, 16), "embedding")
    assert np.allclose(rot @ rot.T, x @ x.T, atol=1e-9)


def test_error_falls_with_bits(spark, x):
    base = _model(spark, x)
    rot = Q.rotate_hadamard(base.weights, 16)
    errs = [Q.quantization_error(rot, Q.quantize(base, b)).first()["mse"] for b in (1, 2, 3, 4)]
    assert errs == sorted(errs, reverse=True)
    uerr = [Q.quantization_error(base.weights, Q.quantize(base, b, "uniform")).first()["mse"] for b in (2, 4, 8)]
    assert uerr == sorted(uerr, reverse=True)


def test_dispatch_rules(spark, x):
    base = _model(spark, x)
    q = Q.quantize(base, 2)
    assert Q.quantize(q, 4, "uniform") is q
    with pytest.raises(ValueError):
        Q.quantize(base, 2, "nope")
    with pytest.raises(ValueError):
        Q.quantize(base, 1, "uniform")
    with pytest.raises(ValueError):
        Q.quantize(base, 5, "turbo-lloyd")
