"""Near boxes are compared many at once, with the same choice as box by box."""

import numpy as np
import pyarrow as pa
import pytest

from tagweave.operators import regions


def boxes(tiles: int, each: int, seed: int) -> pa.Table:
    """Whole tiles of crowded boxes, a third of them border boxes, some of those known as kept."""
    draw = np.random.default_rng(seed)
    n = tiles * each
    x, y = draw.integers(0, 40, n), draw.integers(0, 6, n)
    own = draw.random(n) < 0.7
    return pa.table({
        "tile": np.repeat(np.arange(tiles), each), "pos": np.tile(np.arange(each), tiles), "x1": x, "y1": y,
        "x2": x + 60 + draw.integers(0, 8, n), "y2": y + 50, "own": own, "kept": ~own & (draw.random(n) < 0.5),
    })


def one_by_one(table: pa.Table) -> list[tuple]:
    """First-come selection spelt out."""
    chosen, tiles = [], {}
    for row in table.to_pylist():
        tiles.setdefault(row["tile"], []).append(row)
    for rows in tiles.values():
        told = []
        for row in rows:
            state = 1 if row["own"] or row["kept"] else 2
            for other, was in zip(rows, told):
                w, h = (min(row[f"{a}2"], other[f"{a}2"]) - max(row[f"{a}1"], other[f"{a}1"]) + 1 for a in "xy")
                inter = max(w, 0) * max(h, 0)
                area = sum((r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1) for r in (row, other))
                if was and inter / (area - inter) > 0.86:
                    if was == 1:
                        state = 0
                        break
                    state = state if row["kept"] else 2
            told.append(state)
        chosen += [(r["tile"], r["pos"], state == 1) for r, state in zip(rows, told) if r["own"] and state]
    return chosen


@pytest.mark.parametrize("pairs", [1, 50, 200_000])
def test_blocks_choose_as_one_by_one(monkeypatch, pairs):
    monkeypatch.setattr(regions, "_PAIRS", pairs)
    table = boxes(30, 40, seed=5)
    keep = regions._settle(["tile"], ["tile", "pos"])
    found = [tuple(r.values()) for batch in keep(iter(table.to_batches(max_chunksize=170))) for r in batch.to_pylist()]
    assert found == one_by_one(table) and {kept for *_, kept in found} == {True, False}


def test_many_small_tiles_are_compared_together(monkeypatch):
    """A call of numpy per box took most of the time of near_boxes."""
    calls, minimum = [], np.minimum
    keep = regions._settle(["tile"], ["tile", "pos"])
    monkeypatch.setattr(np, "minimum", lambda *a: calls.append(1) or minimum(*a))
    assert list(keep(iter(boxes(500, 20, seed=2).to_batches()))) and len(calls) < 50
