"""Hashes of keys whose product with the factors is beyond a BIGINT, and the queries that pick by them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from emberframe.operators.sampling import hash_unit
from tests.test_queries import CORE, DATA, canon


@pytest.mark.parametrize("key", [0, 7, 346_000 * 10007, 1_300_000 * 10007 + 9000, 2**31 * 10007, 2**63 - 1, -5, -(2**63)])
def test_hash_of_large_keys(spark, key):
    got = spark.range(1).select(hash_unit(F.lit(key).cast("bigint"))).first()[0]
    assert got == ((key * 2654435761 + 42) % 1000003 + 0.5) / 1000003.0


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The picked table with fires of seven digits."""
    at = str(tmp_path_factory.mktemp("large"))
    spark.read.parquet(f"{DATA}/picked.parquet").withColumn("fire_id", F.col("fire_id") + 1_300_000).write.parquet(f"{at}/picked.parquet")
    return at


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["a7_weight_sweep", "qe_survey_budgets", "t3_balanced_pairs", "t4_cheapest_pairs", "w2_capped_days"])
def test_fires_of_seven_digits(spark, large, name):
    con = duckdb.connect()
    con.execute(f"create view picked as select * from '{large}/picked.parquet/*.parquet'")
    con.execute(f"create view regions as select * from '{DATA}/regions.parquet'")
    # The SQL of the query in integers that hold the product.
    want = con.sql(CORE.sql[name].replace("fire_id::bigint * 10007", "fire_id::hugeint * 10007")).df()
    assert len(want)
    assert canon(CORE.queries[name](spark, large).toPandas()) == canon(want)
