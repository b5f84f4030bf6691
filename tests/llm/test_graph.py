import pytest

from tidewater.llm import graph


def test_components_settle_or_fail(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    assert {(r.node, r.component) for r in graph.components(links).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError):
        graph.components(links, rounds=1)
