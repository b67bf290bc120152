import random

import numpy as np
import pyarrow as pa
import pytest

from emberlake.operators.dissolve import dissolve_cells
from emberlake.operators.rectangles import as_arrow, union, whole_groups


def rings_by_walk(rects):
    """Polygons of integer rectangles by unit squares: flood fill for the pieces, then a walk with the sharpest left turn."""
    squares = {(x, y) for w, s, e, n in rects for x in range(w, e) for y in range(s, n)}
    piece, pieces = {}, 0
    for start in squares:
        todo = [start] if start not in piece else []
        pieces += bool(todo)
        while todo:
            at = todo.pop()
            if at in squares and at not in piece:
                piece[at] = pieces
                todo += [(at[0] + dx, at[1] + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    out = {}
    for x, y in squares:
        for a, b, other in (((x, y), (x + 1, y), (x, y - 1)), ((x + 1, y), (x + 1, y + 1), (x + 1, y)), ((x + 1, y + 1), (x, y + 1), (x, y + 1)), ((x, y + 1), (x, y), (x - 1, y))):
            if other not in squares:
                out[a, (b[0] - a[0], b[1] - a[1])] = (b, piece[x, y])
    parts = {}
    for first in sorted(out):
        if first not in out:
            continue
        ring, at, owner = [], first, out[first][1]
        while at in out:
            end, _ = out.pop(at)
            ring.append(at)
            dx, dy = at[1]
            at = next(((end, t) for t in ((-dy, dx), (dx, dy), (dy, -dx)) if (end, t) in out), (end, None))
        bent = [p[0] for i, p in enumerate(ring) if p[1] != ring[i - 1][1]]
        parts.setdefault(owner, []).append([*bent, bent[0]])
    return sorted(parts.values())


def found(rects_by_group):
    rows = [(g, *r) for g, rects in enumerate(rects_by_group) for r in rects]
    columns = [np.array(c, dtype=np.int64) for c in zip(*rows)]
    polygons = union(*columns)
    shown = [[[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in as_arrow(polygons).to_pylist()]
    groups = [[] for _ in rects_by_group]
    for g, rings in zip(polygons.group.tolist(), shown):
        groups[g].append(rings)
    return [sorted(g) for g in groups], polygons


def test_union_matches_unit_squares_with_holes_and_touching_corners():
    draw = random.Random(5)
    groups = []
    for _ in range(300):
        rects = []
        for _ in range(draw.randint(1, 14)):
            w, s = draw.randint(0, 7), draw.randint(0, 7)
            rects.append((w, s, w + draw.randint(1, 3), s + draw.randint(1, 3)))
        groups.append(rects)
    # A ring around an island with a hole of its own.
    frame = lambda n, at: [(at, at, at + n, at + 1), (at, at + n - 1, at + n, at + n), (at, at, at + 1, at + n), (at + n - 1, at, at + n, at + n)]
    groups.append(frame(9, 0) + frame(5, 2))
    shown, polygons = found(groups)
    assert shown == [rings_by_walk(rects) for rects in groups]
    squares = sum(len({(x, y) for w, s, e, n in rects for x in range(w, e) for y in range(s, n)}) for rects in groups)
    assert polygons.area.sum() == squares


def test_runs_are_listed_a_bounded_number_at_a_time(monkeypatch):
    from emberlake.operators import rectangles

    draw = random.Random(6)
    rects = [(w, s, w + draw.randint(1, 30), s + draw.randint(1, 5)) for w, s in ((draw.randint(0, 40), draw.randint(0, 40)) for _ in range(60))]
    whole = found([rects])[0]
    monkeypatch.setattr(rectangles, "RUNS", 7)
    assert found([rects])[0] == whole


@pytest.mark.parametrize("size", [1, 3, 100])
def test_groups_are_not_torn_by_batches(size):
    keys = [k for k, n in zip("abcdef", (1, 5, 2, 9, 1, 4)) for _ in range(n)]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 3]}) for i in range(0, len(keys), 3)]
    tables = [t["k"].to_pylist() for t in whole_groups(iter(batches), "k", size)]
    assert [k for t in tables for k in t] == keys
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_groups_in_tasks_and_spread_groups_give_the_same_rings(spark):
    draw = random.Random(7)
    cells = [(f"g{g}", draw.randint(0, 5), draw.randint(0, 5), 0.5 + 0.2 * (g % 3), 0.5 + 0.35 * (g % 2)) for g in range(12) for _ in range(14)]
    df = spark.createDataFrame(cells, "g string, c long, r long, hc double, hr double").distinct()
    read = lambda n: {(r.g, round(r.outer_area, 6), str(r.rings)) for r in dissolve_cells(df, "g", "c", "r", "hc", "hr", n).collect()}
    assert read(1_000) == read(0)
    assert read(11) == read(0)


def test_small_groups_take_no_rounds_over_all_edges(spark, monkeypatch):
    from emberlake.operators import dissolve

    monkeypatch.setattr(dissolve, "chain_rings", lambda edges: pytest.fail("edges of small groups were spread"))
    df = spark.createDataFrame([("a", 0, 0, 0.5, 0.5), ("a", 1, 0, 0.5, 0.5), ("b", 3, 3, 0.5, 0.5)], "g string, c long, r long, hc double, hr double")
    assert sorted((r.g, len(r.rings[0]), r.outer_area) for r in dissolve.dissolve_cells(df, "g", "c", "r", "hc", "hr").collect()) == [("a", 5, 2.0), ("b", 5, 1.0)]
