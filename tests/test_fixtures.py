"""Single rules on literal rows, against the rows they must give."""

import duckdb
import pytest

from tests.fixture_queries import FIXED
from tests.test_catalog import SF, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(FIXED))
def test_rule(spark, name):
    run, sql = FIXED[name]
    assert rows(run(spark, SF).toPandas()) == rows(duckdb.sql(sql).df())


def test_a_confidence_that_is_missing_is_moderate(spark):
    from tracelens.operators import answers

    told = [("a", '{"edad_rango": {"valor": "30-34"}, "inferencias_blandas": [{"categoria": "x", "valor": "y"}, {"categoria": "x", "valor": "z", "confianza": true}, {"categoria": "x", "valor": "w", "confianza": -3}]}')]
    df = spark.createDataFrame(told, "profile_id string, json string")
    assert answers.from_model(df).count() == 0  # a band needs more than a moderate confidence
    assert sorted((r["value"], r["confidence"]) for r in answers.soft_inferences(df).collect()) == [("w", 0.0), ("y", 0.5), ("z", 0.5)]
