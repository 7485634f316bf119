import numpy as np
import pytest

from tidemark.llm import repeats


@pytest.mark.parametrize("factor", [repeats.M1, np.uint64(0)])
def test_groups_of_equal_cells(monkeypatch, factor):
    """Equal cells of one size stand together, by document; with a hash that says nothing too."""
    monkeypatch.setattr(repeats, "M1", factor)
    rng = np.random.default_rng(2)
    flat, start, size, doc = rng.integers(0, 2, 400).astype(np.uint8), rng.integers(0, 380, 900), rng.integers(1, 9, 900), rng.integers(0, 50, 900)
    cells = repeats._cells(flat, start, size, 84)
    order, group = repeats._group(cells, size, doc)
    key = [(flat[s : s + n].tobytes(), n) for s, n in zip(start, size)]
    assert sorted(order) == list(range(900)) and group[-1] + 1 == len(set(key))
    assert len({(g, key[o]) for g, o in zip(group, order)}) == len(set(key))
    assert all(g != h or doc[a] <= doc[b] for g, h, a, b in zip(group, group[1:], order, order[1:]))


def test_twins_and_hashes_of_runs(monkeypatch):
    monkeypatch.setattr(repeats, "NEAR", 64)
    rng = np.random.default_rng(3)
    flat = rng.integers(0, 2, 900).astype(np.uint8)
    flat[500:700] = flat[100:300]
    start, long = np.array([0, 70, 71, 300, 500, 640, 800]), np.array([60, 1, 35, 20, 35, 100, 50])
    h = repeats._hash_runs(flat, start, long, 50)
    own = [flat[a + i : a + i + 50].tobytes() for a, n in zip(start, long) for i in range(n)]
    assert len(h) == len(own) and len(set(h.tolist())) == len(set(own)) == len(set(zip(h.tolist(), own)))
    assert repeats._twins(h).tolist() == [i for i, x in enumerate(own) if own.count(x) > 1] != []
    assert not len(repeats._twins(h[:0])) and not len(repeats._twins(h[:1]))
