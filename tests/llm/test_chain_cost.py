"""Chains without trees where few matches tell, and ends of alignments by the bits of one number."""

import random

import numpy as np
import pytest

from tessera.llm import chaining


def test_looking_back_finds_what_trees_find(monkeypatch):
    rng = np.random.default_rng(5)
    for wide, n in [(400, 60), (120, 200), (30, 300), (3000, 40), (1, 3), (5, 0)]:
        pos, at = rng.integers(0, wide, n), rng.integers(0, wide, n)
        on = rng.random(n) < 0.5
        at[on] = pos[on] + 7  # a diagonal among the others, with equal matches
        got = []
        for look in (0, 3, chaining.LOOK, 10_000):
            monkeypatch.setattr(chaining, "LOOK", look)
            got.append(chaining.chains(pos, at))
        assert got[0] == got[1] == got[2] == got[3]


def test_a_diagonal_with_strays_needs_no_tree(monkeypatch):
    pos = np.arange(0, 900, 3)
    at = pos + 11
    stray = pos[::9]
    monkeypatch.setattr(chaining, "Reach", lambda reach: pytest.fail("a tree was made"))
    found = chaining.chains(np.concatenate([pos, stray]), np.concatenate([at, stray + 40_000]))
    assert found[0] == (0, 897, 11, 908, 300)


def test_best_end_is_the_least_beginning_of_the_longest_subsequence(monkeypatch):
    rng = random.Random(8)
    for n, m, kinds in [(48, 88, 60), (48, 88, 3), (5, 5, 2), (0, 4, 2), (4, 0, 2), (30, 70, 30)] * 8:
        x, y = ([rng.randrange(kinds) for _ in range(k)] for k in (n, m))
        row = [0] * (m + 1)
        for w in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(row[j] + 1 if v == w else max(row[j + 1], new[j]))
            row = new
        got = chaining._best_end(np.array(x, np.uint64), np.array(y, np.uint64))
        assert got == (row[-1], row.index(row[-1]))
