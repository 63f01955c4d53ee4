"""Joins of tables that are made from texts: their sizes are guessed far too small, so none of them may be broadcast."""

import pytest

import __spark_entry__
from loomline import code_queries
from loomline.operators import chains, code

#: The tables that a plan may broadcast: the keywords of completion.
FIXED = {"ide_completion": 1}


@pytest.mark.parametrize("name", ["ide_scope_tokens", "ide_hover", "ide_completion", "ide_members", "ide_chain"])
def test_tables_made_from_texts_are_not_broadcast(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= FIXED.get(name, 0)


def test_members_of_chains_are_not_broadcast(spark):
    every = code.symbols(code_queries.FAMILY.files(spark.read.parquet("/root/testdata/sf0.001/customer.parquet")))
    plan = chains.all_members(every, code.current_symbols(every))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
