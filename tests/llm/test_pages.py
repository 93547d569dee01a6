"""Decoding over a page's tree and the boosted trees against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from tessera.llm.boosting import BoostedTrees
from tessera.llm.html_text import Page


def tree(rng, n):
    page = Page.__new__(Page)
    page.tag, page.parent = ["div"] * n, [-1, *(rng.randrange(i) for i in range(1, n))]
    return page


@pytest.mark.parametrize("seed", range(40))
def test_decoding_is_the_likeliest_of_all_labellings(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    page = tree(rng, n)
    p = [rng.choice([rng.random(), 0.0, 1.0, 0.5, rng.random() ** 4]) for _ in range(n)]
    like = lambda main: sum(math.log(max(1e-9, x if m else 1 - x)) for m, x in zip(main, p))
    legal = [main for main in itertools.product([False, True], repeat=n) if all(not main[i] or main[page.parent[i]] for i in range(1, n))]
    got = page.decoded(p)
    assert tuple(got) in legal and like(got) >= max(map(like, legal)) - 1e-9


def test_contradictions_between_ancestors_and_descendants_are_settled():
    page = Page.__new__(Page)
    page.tag, page.parent = ["body", "div", "p", "p"], [-1, 0, 1, 1]
    assert page.decoded([0.9, 0.4, 0.95, 0.9]) == [True, True, True, True]  # two sure children carry their parent
    assert page.decoded([0.9, 0.01, 0.6, 0.3]) == [True, False, False, False]  # one unsure child doesn't


@pytest.mark.parametrize("seed", range(6))
def test_first_split_is_that_of_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (200, 4)).astype(float)
    y = (x[:, seed % 4] + rng.normal(0, 2, 200) > 4).astype(float)
    weight = rng.uniform(0.5, 2, 200)
    model = BoostedTrees.train(x, y, weight, trees=1, depth=1)
    mean = np.average(y, weights=weight)
    g, h = (mean - y) * weight, mean * (1 - mean) * weight * np.ones(200)

    def gain(j, limit):
        left = x[:, j] <= limit
        if h[left].sum() < 3 or h[~left].sum() < 3:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + 1)

    best = max(gain(j, v) for j in range(4) for v in range(9))
    feature, limit, value = model.trees[0]
    assert abs(gain(feature[0], limit[0]) - best) < 1e-9
    left = x[:, feature[0]] <= limit[0]
    want = [-0.25 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)]
    assert np.allclose(value, want) and np.allclose(model.probability(x), 1 / (1 + np.exp(-(model.start + np.where(left, *want)))))
