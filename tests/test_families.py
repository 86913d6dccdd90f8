"""Families of numbered names, compared by keys and automata, against one by one."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from quillstone.operators import contact_classes, families


def compared(left: list[str], right: list[str], weight, least: float) -> contact_classes._Links:
    rows = pd.DataFrame({"plain": left + right, "core": left + right, "before": [[] for _ in left + right], "contacts": weight})
    links, mine = contact_classes._Links(rows, least), np.arange(len(left))
    links.compare(mine, np.arange(len(left), len(rows)) if right else mine)
    return links


def classes(n: int, *edges: list) -> list[int]:
    pairs = np.array([e for some in edges for e in some] or [(0, 0)])
    return families.united(np.arange(n), pairs[:, 0], pairs[:, 1])[0].tolist()


@pytest.mark.parametrize("least", [0.3, 0.7, 0.85, 0.95, 1.0])
@pytest.mark.parametrize("digits", ["01", "0123456789"])
def test_families_equal_names_one_by_one(monkeypatch, least, digits):
    r = random.Random(f"{least} {digits}")
    forms = ("customer 0{}", "customer 0{}", "supplier 0{}", "{} acme {}", "zed {} corner", "{}q", "éé 0{}")

    def names(n, but=()):
        return sorted({r.choice(forms).format(x, x) for x in ("".join(r.choices(digits, k=r.choice((3, 4, 4, 6)))) for _ in range(n))} - set(but))

    for size in (8, 90, 200):
        left = names(size)
        for right in ([], names(size, left)):
            weight = np.array(r.choices((1, 1, 3), k=len(left) + len(right)))
            monkeypatch.setattr(families, "LEAST", 2)
            got = compared(left, right, weight, least)
            monkeypatch.setattr(families, "LEAST", 10**9)
            want = compared(left, right, weight, least)
            assert got.links.tolist() == want.links.tolist()
            assert got.best.tolist() == want.best.tolist()
            assert got.partner[got.best >= least].tolist() == want.partner[got.best >= least].tolist()
            inner = [*compared(left, [], weight[: len(left)], least).edges, *((a + len(left), b + len(left)) for a, b in (compared(right, [], weight[len(left) :], least).edges if right else []))]
            assert classes(len(weight), got.edges, inner) == classes(len(weight), want.edges, inner)


def test_numbered_names_are_not_compared_one_by_one(monkeypatch):
    def never(*_):
        raise AssertionError("one by one")

    monkeypatch.setattr(contact_classes, "similarities", never)
    left, right = ([f"customer {k:09d}" for k in range(a, a + 3000) if k % 11] for a in (0, 500_000))
    got = compared(left, right, np.ones(len(left) + len(right), int), 0.7)
    assert (got.links > 0).all() and len(got.edges) < 10 and got.links[: len(left)].sum() == got.links[len(left) :].sum()
