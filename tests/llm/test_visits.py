"""Few sampled links don't make few visits."""

import numpy as np

from logweft.llm import multiindex


def test_rare_near_copies_are_found(spark):
    rng = np.random.default_rng(11)
    base = multiindex.unit(rng.normal(size=(6000, 32)))
    aside = rng.normal(size=(150, 32))
    aside -= (aside * base[:150]).sum(1, keepdims=True) * base[:150]
    near = 0.945 * base[:150] + np.sqrt(1 - 0.945**2) * multiindex.unit(aside)
    vectors = np.concatenate([base, near])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    exact = (multiindex.unit(vectors) @ multiindex.unit(vectors).T >= 0.93).sum() - len(vectors)
    found = sum(r["n_links"] for r in multiindex.linked_vectors(table).collect())
    assert found >= 0.95 * exact > 200


def test_least_visits_reach_planted_pairs():
    rng = np.random.default_rng(5)
    vectors = multiindex.unit(rng.normal(size=(3000, 32)))
    assert multiindex._planted_visits(multiindex.Grid(vectors, 14), vectors) > 4
