from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from demandspark.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """{(id, code, error, label_error)} as a sorted list, and the hash of the codebooks."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    # Largest id for null, so that nulls come last.
    fine = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not fine:
        return [], None
    points = [[math.floor(4096 * Fraction(float(np.float32(x)))) for x in r[1]] for r in fine]
    width = len(points[0]) // parts
    cut = lambda p, k: p[k * width : (k + 1) * width]
    books = [[cut(p, k) for p in points[:entries]] for k in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda i: (square(x, book[i]), i))
    for _ in range(rounds):
        for k, book in enumerate(books):
            of = [near(cut(p, k), book) for p in points]
            for i in range(len(book)):
                mine = [cut(p, k) for p, e in zip(points, of) if e == i]
                if mine:
                    book[i] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], {}
    for r, p in zip(fine, points):
        best = [near(cut(p, k), books[k]) for k in range(parts)]
        error = sum(square(cut(p, k), books[k][e]) for k, e in enumerate(best))
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{e:02x}" for e in best), error, r[2]))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[la]) for i, c, e, la in out), key=str), sha


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as code", "1 as id", "2 as error").repartition(3)
    got = vc.compressed(df, **more).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str), {r.codebooks_sha256 for r in got}


@pytest.mark.parametrize("n, dims", [(300, 16), (5, 8), (1, 8)])
def test_codes_against_all_distances(spark, monkeypatch, n, dims):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]
    # Repeated rows and ids, copies of one vector, vectors that take no part.
    rows += rows[:3] + [(7, rows[0][1], 1)] + [(1000 + i, rows[0][1], 2) for i in range(40)]
    odd = [(2000, None, 1), (2001, [None] * dims, 1), (2002, [float("nan")] * dims, 1), (2003, [float("-inf")] * dims, 1), (None, rows[0][1], None)]
    want, sha = brute(rows + odd)
    got, shas = run(spark, rows + odd)
    assert got == want and shas == {sha}


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**60 * (i % 5)), 1.0, -(2.0**70) * (i % 3), 0.5, 0.0, 0.0, 0.0, float(i)], 1) for i in range(40)]
    want, sha = brute(rows)
    got, shas = run(spark, rows)
    assert shas == {sha} and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == (w[2] if w[2] < 2**63 else None) for g, w in zip(got, want))


def test_other_lengths_and_empty_tables(spark):
    rows = [(i, [0.1 * i] * 10, 1) for i in range(20)] + [(50, [1.0] * 8, 1), (51, [], 2)]
    got, _ = run(spark, rows)
    assert [g[0] for g in got] == sorted(range(20), key=str)
    assert run(spark, []) == ([], set()) and run(spark, [(1, None, 1)]) == ([], set())
    assert run(spark, [(1, [], 1)])[0] == [(1, "00" * 8, 0, 0)]


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_cover_tree_invariants_and_assignment(monkeypatch, leaf):
    monkeypatch.setattr(vc, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    points = np.concatenate([rng.integers(-900, 900, (400, 4)), np.repeat(rng.integers(-9, 9, (2, 4)), 50, 0)])
    order, nodes = vc.cover_tree(points)
    assert sorted(order) == list(range(len(points)))
    for x in nodes:
        own = points[order[x["first"] : x["last"]]]
        assert (np.sqrt(((own - points[x["centre"]]) ** 2).sum(1)) <= x["radius"] + 1e-6).all()
        kids = nodes[x["child"] : x["child"] + x["children"]]
        if len(kids):
            assert kids[0]["centre"] == x["centre"] and kids["first"][0] == x["first"] and kids["last"][-1] == x["last"]
            half = 2.0 ** (np.ceil(np.log2(x["radius"])) - 1)
            centres = points[kids["centre"]]
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
            assert (apart > half).all() and (kids["radius"] <= half).all() and len(kids) > 1
    sums = np.concatenate([np.zeros((1, 4), int), np.cumsum(points[order], 0)])
    book = np.concatenate([points[:6], points[:2]])
    entry, count, total = vc.assigned(sums, nodes, points[nodes["centre"]], book)
    want = ((points[order][:, None] - book) ** 2).sum(2).argmin(1)
    assert (entry == want).all() and (count == np.bincount(want, minlength=8)).all()
    assert all((points[order][want == k].sum(0) == total[k]).all() for k in range(8))
