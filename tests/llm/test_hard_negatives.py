"""Hard negatives against brute force, with codebooks, parts and rounds small enough that all paths are taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import hard_negatives as hn


def brute(rows, anchors, n_pos=5, n_neg=5):
    out = []
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows})
    for a in (r for r in rows if anchors(r[0])):
        def score(r):
            return sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023
        others = [r for r in rows if r[0] != a[0]]
        pos = sorted((-score(r), r[0]) for r in others if r[1] == a[1])[:n_pos]
        neg = sorted((-score(r), r[0]) for r in others if r[1] != a[1])
        for ps, p in pos:
            window = [(s, i) for s, i in neg if 80 * -ps <= 100 * -s <= 100 * -ps][:n_neg]
            out += [(a[0], p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(window)]
    return sorted(out)


def made(kind, n=400, width=8, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)) * 100
    if kind == "clustered":
        v = rng.normal(size=(12, width))[rng.integers(12, size=n)] * 300 + v * 0.2
    if kind == "copies":  # a third of the rows are one vector, of two labels
        v[: n // 3] = v[0]
    if kind == "negative":  # no two products are positive
        v = np.where(np.arange(n)[:, None] % 2, 1, -1) * np.abs(v)
    label = rng.integers(3, size=n)
    if kind == "copies":
        label[: n // 3] = np.arange(n // 3) % 2
    return [(int(i), int(label[k]), [int(x) for x in np.floor(v[k])]) for k, i in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("kind", ["plain", "clustered", "copies", "negative"])
def test_hard_negatives_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "PART", 16)
    monkeypatch.setattr(hn, "CHUNK", 4)
    rows = made(kind)
    df = spark.createDataFrame(rows, "id long, label long, v array<long>").withColumns({"anchor": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    got = hn.hard_negatives(df, F.col("id") % 20 == 0, cell_rows=16, first=32)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 20 == 0)


def test_hard_negatives_on_odd_rows(spark):
    rows = [(0, 1, [10, 0, 5]), (0, 1, [10, 0, 5]), (20, None, [1, 2, 3]), (None, 1, [1, 2, 3]), (3, 1, None), (4, 1, [None, 1, 1]), (5, 1, [9, 0]), (6, 2, [9, 0]), (7, 2, [0, 0, 0]), (40, 2, []), (8, 3, [1 << 40, 1, 1]), (9, 2, [8, 1])]
    df = spark.createDataFrame(rows, "id long, label long, v array<long>")
    fine = [(i, label, [*v, *[0] * (3 - len(v))]) for i, label, v in rows if None not in (i, label, v) and None not in v and max(v, default=0) < 1 << 25]
    got = hn.hard_negatives(df, F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(fine, lambda i: i % 20 == 0)
    assert hn.hard_negatives(df.filter("id < 0"), F.lit(True)).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0


def test_products_beyond_doubles_are_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-hn.LARGEST, hn.LARGEST, size=(5, 600)).astype(float) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert hn.products(a, b).tolist() == want
    scores = np.array(want)
    for need in (2, 5, 9):
        row, col = hn.firsts(scores, np.ones(scores.shape, dtype=bool), need)
        assert [col[row == k].tolist() for k in range(5)] == [sorted(range(5), key=lambda j: (-want[k][j], j))[:need] for k in range(5)]


def test_bounds_of_cells_hold_and_far_cells_are_not_visited():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16)) * 500
    rows = np.floor(centres[rng.integers(30, size=3_000)] + rng.normal(size=(3_000, 16)) * 20)
    books = tuple(hn.codebook(h, 8) for h in (rows[:, :8], rows[:, 8:]))
    (a, fa), (b, fb) = (hn.nearest(h, book) for h, book in zip((rows[:, :8], rows[:, 8:]), books, strict=True))
    cells, radii = {}, {}
    for x, y, p, q in zip(a.tolist(), b.tolist(), fa, fb, strict=True):
        cells[x, y] = cells.get((x, y), 0) + 1
        radii[x, y] = tuple(np.maximum(radii.get((x, y), (0.0, 0.0)), (p, q)))
    index = hn.MultiIndex(books, 16, cells, radii, tuple(np.array([max((r[k] for c, r in radii.items() if c[k] == code), default=0.0) for code in range(len(books[k]))]) for k in (0, 1)))
    for q in rows[:20]:
        found = list(index.cells(q))
        bounds = [f[2] for f in found]
        assert {f[:2] for f in found} == set(cells) and bounds == sorted(bounds, reverse=True)
        scores = rows @ q
        for x, y, bound, most, least in found:
            own = scores[(a == x) & (b == y)]
            assert least <= own.min() and own.max() <= most <= bound + 1e-6 + 2
        fifth = np.sort(scores)[-6]
        assert sum(f[2] >= fifth for f in found) < len(found)
