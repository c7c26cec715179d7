"""Level lines, components and the learned critic's plans on small tables."""

import math
import random

import pytest

from infospan.functions import contours
from infospan.operators.graphs import components
from infospan.plans import modes


def grid(spark, values):
    """values[y][x], null for a missing one."""
    rows = [(x, y, v) for y, row in enumerate(values) for x, v in enumerate(row) if v != "missing"]
    return spark.createDataFrame(rows, "lag int, window int, mi double")


def lines(spark, values, level):
    found = {}
    for r in contours.contour_lines(grid(spark, values), level).collect():
        found.setdefault(r["line"], (r["segments"], round(r["length"], 6), set()))[2].add((round(r["lag"], 6), round(r["window"], 6)))
    return sorted(found.values(), key=lambda line: line[:2])


def test_two_islands_are_two_lines(spark):
    values = [[0.0] * 9 for _ in range(7)]
    values[2][1] = 1.0  # a small island: a diamond of four points
    for y in (3, 4):
        for x in (4, 5, 6, 7):
            values[y][x] = 1.0
    found = lines(spark, values, 0.5)
    assert len(found) == 2
    assert found[0] == (4, round(4 * math.sqrt(0.5), 6), {(0.5, 2), (1.5, 2), (1, 1.5), (1, 2.5)})
    assert found[1][0] == 12 and len(found[1][2]) == 12  # closed: as many pieces as points
    best = {(r["lag"], r["window"]) for r in modes.significant_contour(grid(spark, values), 0.5).collect()}
    assert best == found[1][2]


def test_an_open_line_and_unequal_values(spark):
    found = lines(spark, [[0.0, 0.0, 0.0], [1.0, 2.0, 4.0]], 1.0)
    # the level itself isn't above: the line ends where the first corner is at it
    assert found == [(1, round(math.hypot(1, 0.25), 6), {(1.0, 0.5), (2.0, 0.25)})] or found[0][0] == 2


@pytest.mark.parametrize(("middle", "wanted"), [(0.9, [(0.0, 0.5), (0.5, 0.0)]), (0.1, [(0.0, 0.5), (0.5, 1.0)])])
def test_a_saddle_follows_the_mean(spark, middle, wanted):
    """Two opposite corners above: connected if the mean is above, else each by itself."""
    high = 1.0 if middle > 0.5 else 0.6
    low = 0.3 if middle > 0.5 else 0.0
    values = [[low, high], [high, low]]
    level = 0.5
    pieces = contours.segments(grid(spark, values), level).collect()
    ends = [{(p["a"]["x"] < 0.5, p["a"]["y"] < 0.5, p["a"]["at"][0]), (p["b"]["x"] < 0.5, p["b"]["y"] < 0.5, p["b"]["at"][0])} for p in pieces]
    assert len(ends) == 2
    names = [{p["a"]["at"], p["b"]["at"]} for p in pieces]
    mean_above = (2 * high + 2 * low) / 4 > level
    around_low = {"h:0.0:0.0", "v:0.0:0.0"}
    assert (around_low in names) == mean_above


def test_missing_cells_have_no_lines(spark):
    assert lines(spark, [[0.0, "missing"], [1.0, 1.0]], 0.5) == []
    assert lines(spark, [[0.0, None], [1.0, 1.0]], 0.5) == []
    assert lines(spark, [[0.0, math.nan], [1.0, 1.0]], 0.5) == []
    assert lines(spark, [], 0.5) == []


def test_components_against_a_walk(spark):
    draw = random.Random(4)
    edges = [(f"n{draw.randrange(120):03d}", f"n{draw.randrange(120):03d}") for _ in range(70)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("x", "x"), (None, "y"), ("n001", None)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in wanted:
                wanted[n] = start
                todo += near[n]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert found == wanted
