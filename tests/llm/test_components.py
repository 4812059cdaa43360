"""Components are finished, or there are none."""

import random

import pytest

from kgloom.llm import simhash


def test_unfinished_components_raise(spark):
    nodes = list(range(200))
    random.Random(3).shuffle(nodes)
    chain = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        simhash.components(chain, rounds=1)
    got = simhash.components(chain).collect()
    assert len(got) == 200 and {r.component for r in got} == {0}
