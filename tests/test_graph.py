"""Components by rounds of contraction."""

from __future__ import annotations

import random

import pytest

from lakepress.operators import graph
from lakepress.plans import workdir


def _found(spark, edges, parts=4):
    return {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(parts)).collect()}


@pytest.mark.parametrize("drawn", [False, True])
def test_rounds_go_on_with_what_is_left(spark, monkeypatch, drawn):
    """Rows written over all rounds stay below a few times the graph, also along paths, whose rounds are many."""
    written = []

    def counted(df, name, schema=None):
        out = workdir.spill(df, name, schema)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "spill", counted)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 20)
    n, names = 3000, list(range(3000))
    if drawn:
        random.Random(5).shuffle(names)
    # two paths, the second from the middle on
    edges = [(names[i], names[i + 1]) for i in range(n - 1) if i != n // 2]
    ends = (names[: n // 2 + 1], names[n // 2 + 1 :])
    assert _found(spark, edges, 8) == {x: min(part) for part in ends for x in part}
    assert sum(written) < (10 if drawn else 18) * n


def test_many_rounds_against_union_find(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 5)
    rng = random.Random(9)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [(0, i) for i in range(5000, 5200)] + [(9000, 9000), (9001, 9001)]
    want = {n: r for r, n in graph.forest(iter(edges))}
    want |= {r: r for r in want.values()}
    assert _found(spark, edges) == want
