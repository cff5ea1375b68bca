"""Counts of rare tokens return packed by the task that asked, and are summed there."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from logweft.llm import ppm


def test_sums_of_packed_counts(spark, monkeypatch):
    monkeypatch.setattr(ppm, "ANSWERS", 50)
    rng = random.Random(4)
    rows = [((task << 32) + group, rng.randrange(9), rng.choice([0, 0, 1, 7, 1 << 33])) for task in (0, 5, 1 << 20) for group in (0, 3) for _ in range(200)]
    counts = spark.createDataFrame(rows, "home long, place long, n long").repartition(3)
    got = {(r.home, r.place): (r.rare_score, r.rare_known) for r in ppm.token_sums(counts, -2.5).collect()}
    assert got.keys() == {r[:2] for r in rows}
    for key, (score, known) in got.items():
        own = [n for *at, n in rows if tuple(at) == key]
        assert known == sum(n > 0 for n in own)
        assert score == pytest.approx(sum(math.log10(n + 0.5) + 2.5 for n in own))


def test_no_rows_no_sums(spark):
    assert ppm.token_sums(spark.createDataFrame([], "home long, place long, n long"), 1.0).collect() == []


def test_packed_counts_take_few_bytes_a_token():
    rng = np.random.default_rng(3)
    home, place, n = np.full(20_000, (7 << 32) + 2), rng.integers(0, 900, 20_000), rng.geometric(0.05, 20_000)
    ((task, packed),) = ppm._packed_answers(home, place, n)
    assert task == 7 and len(packed) < 3 * len(n)  # a row for each took 8 after compression
    at, counts = ppm._unpacked_answers(packed)
    assert sorted(zip(at.tolist(), counts.tolist())) == sorted(zip(((2 << 32) + place).tolist(), n.tolist()))
