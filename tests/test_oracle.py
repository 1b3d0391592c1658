"""Every registered query with an oracle text agrees with DuckDB at sf0.001
(row count, column names, order-insensitive values)."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from pyspark.sql import functions as F  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402

#: The corpus operators have tests of their own.
OWN = re.compile(r"op\d+_|pipeline$")
KEYS = sorted(k for k in E.oracle_sql() if not OWN.match(k))


def test_every_query_has_an_oracle():
    assert {k for k in E.queries() if not OWN.match(k)} == set(KEYS)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck_all, sf_small, key):
    sdf = E.queries()[key](spark, sf_small)
    rel = duck_all.sql(E.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    a = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    b = rows_of(rel.columns, rel.fetchall())
    assert len(a) == len(b)
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    ranks = df.groupBy("owner_id").agg(F.max("log_rank").alias("most"), F.count("*").alias("n")).collect()
    assert ranks and all(r.most == r.n <= 50 for r in ranks)
