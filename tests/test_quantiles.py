"""Percentiles by selection in passes against numpy over whole groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators.quantiles import quantiles, selected, with_quantiles

PROBS = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p95": 0.95, "p100": 1.0}


def rows():
    rng = random.Random(3)
    kinds = {
        "a": lambda: rng.randint(0, 5), "b": lambda: rng.gauss(0, 1e6), "c": lambda: 10 ** rng.uniform(-300, 300),
        None: lambda: rng.choice([1.5, -1.5]), "d": lambda: 7.0, "e": lambda: 1 + rng.random() * 1e-15, "f": lambda: rng.choice([1e308, -1e308, 0.0]),
    }
    out = [(k, float(make())) for k, make in kinds.items() for _ in range(rng.choice([101, 1000]))]
    return out + [("one", 3.0), ("none", None), ("a", None)]


@pytest.mark.parametrize("small", [0, 10**6])
def test_equals_numpy(spark, small):
    data = rows()
    frame = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r["g"]: r for r in quantiles(frame, ["g"], "v", PROBS, small).collect()}
    groups = {g: [v for k, v in data if k == g and v is not None] for g, _ in data}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, values in groups.items():
        for name, p in PROBS.items() if values else ():
            assert math.isclose(got[g][name], np.quantile(values, p), rel_tol=1e-12), (g, name)


def test_infinite_values_and_no_groups(spark):
    data = [float("inf"), float("-inf"), 1.0, 2.0, 3.0, float("-inf"), float("inf")]
    frame = spark.createDataFrame([(v,) for v in data], "v double")
    found = quantiles(frame, [], F.col("v"), {"median": 0.5, "low": 0.0, "high": 1.0}, small=0)
    assert found.columns == ["median", "low", "high"] and tuple(found.first()) == (2.0, float("-inf"), float("inf"))
    assert quantiles(frame.where("false"), [], "v", {"median": 0.5}, small=0).count() == 0


def test_a_pass_holds_cells_only(spark):
    frame = spark.range(300_000).selectExpr("'x' AS g", "CAST(id * id AS DOUBLE) AS __v")
    assert selected(frame, ["g"], {"median": 0.5}, small=0).first()["median"] == (149_999**2 + 150_000**2) / 2


def test_summary_keeps_groups_without_values(spark):
    frame = spark.createDataFrame([("a", 1), (None, 3), ("b", None)], "g string, v int")
    out = with_quantiles(frame.groupBy("g").count(), frame, ["g"], "v", {"m": 0.5})
    assert {r["g"]: r["m"] for r in out.collect()} == {"a": 1.0, None: 3.0, "b": None}
