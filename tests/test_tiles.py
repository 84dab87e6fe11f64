"""The block matrix join against plain numpy."""

from __future__ import annotations

import numpy as np

from quern.operators import tiles


def blocks(n, m, d=128, seed=8):
    rng = np.random.default_rng(seed)
    return (tiles.Block([f"{s}{i:04}" for i in range(c)], rng.normal(size=(c, d)).astype(np.float32)) for s, c in (("a", n), ("b", m)))


def test_quantisation_bounds_hold():
    a, b = blocks(50, 60)
    value = (a.codes.astype(float) @ b.codes.T.astype(float)) * a.scale[:, None] * b.scale
    bound = (1 + a.error[:, None]) * b.error + a.error[:, None]
    exact = a.unit(np.arange(50)) @ b.unit(np.arange(60)).T
    assert (np.abs(value - exact) <= bound + 1e-6).all() and bound.max() < 0.05


def test_reached_is_a_lower_bound_of_the_kth():
    x = np.random.default_rng(1).normal(size=(40, 300)).astype(np.float32)
    for axis, k in ((1, 5), (0, 3)):
        low = tiles.reached(x, k, axis)
        kth = np.sort(x, axis=axis).take(-k, axis=axis)
        assert (low <= kth).all() and (low > kth - 1.5).all()
    assert (tiles.reached(x[:, :2], 5, 1) == -9).all()


def test_best_keeps_the_smaller_names_on_ties():
    best = tiles.Best(2, 2)
    best.offer(np.array([0, 0, 1]), np.array([0.5, 0.5, 0.1]), np.array([b"z", b"y", b"x"]))
    best.offer(np.array([0, 1]), np.array([0.5, 0.9]), np.array([b"long", b"w"]))
    assert best.names.tolist() == [[b"long", b"y"], [b"w", b"x"]] and best.worth.tolist() == [[0.5, 0.5], [0.9, 0.1]]


def test_a_home_and_its_visitors(monkeypatch):
    monkeypatch.setattr(tiles, "STRIP_ENTRIES", 700)
    a, b = blocks(90, 70, 16)
    home = tiles.Home(a, 4, 5, True)
    theirs = home.visit(b, True)
    x, y = a.unit(np.arange(90)), b.unit(np.arange(70))
    both, names = np.round(np.vstack([x, y]) @ x.T, 5), a.ids
    np.fill_diagonal(both[:90], -9)
    for i in range(70):
        want = sorted(zip(-both[90 + i], names))[:4]
        assert theirs.names[i].tolist() == [n for _, n in want]
    cross = np.round(x @ y.T, 5)
    for i in range(90):
        want = sorted([*zip(-both[i], names), *zip(-cross[i], b.ids)])[:4]
        assert home.best.names[i].tolist() == [n for _, n in want]
