"""Recipes over one base: shared first steps, steps that change nothing, a start from a path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators.tables import decode
from vectorloom.plans import pipeline as P
from vectorloom.plans.registry import base
from vectorloom.sources import models as MD

INT4 = ("quantize", {"bits": 4, "method": "uniform"})
INT8 = ("quantize", {"bits": 8, "method": "uniform"})
PCA = ("pca", {"dim": 16})


def _rows(model):
    return {r.row_id: np.asarray(r.embedding) for r in decode(model).select("row_id", "embedding").collect()}


def test_recipes_share_first_steps(spark, sf, tmp_path):
    recipes = {"p": [PCA], "p4": [PCA, INT4], "p_pq": [PCA, ("pq", {"num_subvectors": 4, "centroids_per_sub": 8})]}
    done = dict(P.compress_all(base(spark, sf), list(recipes), recipes, str(tmp_path)))
    assert list(done) == ["baseline", "p", "p4", "p_pq"]
    exact = _rows(done["p"])
    assert all(len(v) == 16 for v in exact.values())
    for name in ("p4", "p_pq"):
        near = _rows(done[name])
        assert near.keys() == exact.keys()
        error = sum(((near[i] - exact[i]) ** 2).sum() for i in exact) / sum((v ** 2).sum() for v in exact.values())
        assert 0 < error < (0.02 if name == "p4" else 0.9)


def test_step_that_changes_nothing(spark, sf, tmp_path):
    once = P.run_pipeline(base(spark, sf), [INT8], str(tmp_path))
    twice = P.run_pipeline(base(spark, sf), [INT8, INT4], str(tmp_path))
    assert twice.bits == 8 and twice.weights.count() == once.weights.count() == once.num_rows


def test_start_from_a_path(spark, sf, tmp_path):
    path = MD.save_model(base(spark, sf), str(tmp_path / "saved"))
    model = P.run_pipeline(path, [INT8], str(tmp_path), spark=spark)
    assert model.weights.agg(F.count("*")).first()[0] == model.num_rows


def test_unknown_names(spark, sf):
    with pytest.raises(ValueError, match="nobody registered"):
        P.run_pipeline(base(spark, sf), [("fold", {})])
    with pytest.raises(ValueError, match="no recipe"):
        P.compress_all(base(spark, sf), ["fold"])
