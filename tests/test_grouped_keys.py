"""The grouped kernels are registered over all portfolios and tickers."""

import pytest

from tallyspark.plans import misc_queries as M
from tallyspark.sources import adapters as S


@pytest.mark.parametrize("rows", [M._allocation_rows, M._evidence_rows, M._statement_rows, M._official_rows, M._canonical_rows])
def test_all_keys_reach_the_kernels(spark, rows):
    d = "/root/testdata/sf0.01"
    keys = lambda df: {tuple(r) for r in df.select("portfolio_id", "ticker_id").distinct().collect()}
    assert keys(rows(spark, d)) == keys(S.facts(spark, d))
