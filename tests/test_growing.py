import pytest

from pointweave.operators import growing
from test_graphs import kruskal, some_edges

EDGES = "hi long, lo long, weight double"


def rows(forest, solution):
    return sorted((r.hi, r.lo) for r in forest.collect()), {r.node: (r.component, r.sign) for r in solution.collect()}


@pytest.mark.parametrize(("seed", "ties", "cuts"), [(5, False, (90, 180)), (6, True, (130,)), (7, True, (5, 40))])
def test_increments_equal_one_run(spark, tmp_path, seed, ties, cuts):
    edges = some_edges(seed, ties=ties)
    for lo, hi in zip((0, *cuts), (*cuts, len(edges))):
        got = growing.grow(spark.createDataFrame(edges[lo:hi], EDGES), f"file://{tmp_path}/forest")
        assert rows(*got) == kruskal(edges[:hi]), hi
    assert growing.versions(spark, f"file://{tmp_path}/forest") == (list(range(len(cuts) + 1)), len(cuts) + 1)
    assert rows(*growing.grow(spark.createDataFrame(edges[: cuts[0]], EDGES), f"file://{tmp_path}/forest")) == kruskal(edges)


def test_only_groups_that_can_change_are_solved_again(spark, monkeypatch):
    """Trees that are joined without a cycle, and edges that are less than all of their tree, need no second solution."""
    edges = [(2, 1, 5.0), (3, 2, -4.0), (11, 10, 3.0), (12, 11, 6.0), (21, 20, 2.0), (22, 21, -7.0)]
    first = growing.grown(*growing.loaded(spark, "file:///nowhere"), spark.createDataFrame(edges, EDGES))
    sizes = []
    solve = growing.spanning_forest
    monkeypatch.setattr(growing, "spanning_forest", lambda e: sizes.append(e.count()) or solve(e))
    joining = [(10, 3, -1.0), (30, 22, 2.5)]
    second = growing.grown(*first, spark.createDataFrame(joining, EDGES))
    assert rows(*second) == kruskal(edges + joining) and sizes == []
    closing = [(3, 1, 0.5), (12, 10, -0.25), (22, 20, 6.5)]  # the last pushes out (21, 20)
    third = growing.grown(*second, spark.createDataFrame(closing, EDGES))
    assert rows(*third) == kruskal(edges + joining + closing)
    assert sizes == [4]  # three edges of the forest of 20, 21, 22 and 30, and the new one
    assert (21, 20) not in rows(*third)[0]


def test_what_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/forest"
    odd = spark.createDataFrame([(1, 1, 1.0), (None, 2, 1.0), (3, 2, None), (5, 4, float("nan"))], EDGES)
    assert rows(*growing.grow(odd, path)) == ([], {})
    edges = some_edges(8, n=30, m=50)
    growing.grow(spark.createDataFrame(edges, EDGES), path)
    assert rows(*growing.grow(odd, path)) == kruskal(edges)
    # a version that was cut short
    growing.loaded(spark, path)[0].write.parquet(f"{path}/version-3/forest")
    assert growing.versions(spark, path) == ([0, 1, 2], 4)
    assert rows(*growing.loaded(spark, path)) == kruskal(edges)
    with pytest.raises(ValueError):
        growing.loaded(spark, path, 3)
    assert growing.saved(*growing.loaded(spark, path), path) == 4
