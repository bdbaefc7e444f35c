"""Vector codes against Lloyd's rounds in plain Python numbers, with ties, and against all distances."""

import hashlib
import math
import random

import pytest

from codexmill.llm import codes


def plain(rows, rounds=codes.ROUNDS):
    """rows: (vec_id, vector, label), kept ones of one length. vec_id by order -> (code, error), and the entries' hash."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    ints = [[int(x) * 4096 if abs(x) >= 2**53 else math.floor(x * 4096) for x in v] for _, v, _ in rows]
    cuts = [p * width // 8 for p in range(9)]
    parts = [[v[cuts[p] : cuts[p + 1]] for v in ints] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(8):
            taken = [near(p, x) for x in parts[p]]
            for e in range(len(books[p])):
                mine = [x for x, t in zip(parts[p], taken) if t == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, (vec_id, _, label) in enumerate(rows):
        chosen = [near(p, parts[p][i]) for p in range(8)]
        out.append((vec_id, "".join(f"{c:02x}" for c in chosen), sum(far(parts[p][i], books[p][c]) for p, c in enumerate(chosen)), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fits(e), fits(sums[label]), digest) for i, c, e, label in out), key=str)


def coded(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return codes.with_label_errors(codes.encode(table))


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_rounds(spark, seed):
    """A coarse grid, so that ties abound; repeated rows and ids."""
    rng = random.Random(seed)
    width = (16, 24, 13)[seed]
    rows = [(rng.randrange(150), [rng.randrange(-3, 4) / 4096 for _ in range(width)], rng.choice([0, 1, None])) for _ in range(300)]
    rows += rows[:40]
    assert sorted(map(tuple, coded(spark, rows).collect()), key=str) == plain(rows)


def test_wide_numbers_and_few_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e300, -1e300, 3.5, 1e18, -2e-9, 0.0]) for _ in range(8)], 1) for i in range(40)]
    assert sorted(map(tuple, coded(spark, rows, "double").collect()), key=str) == plain(rows)
    few = [(i, [float(i), -float(i)] * 4, 0) for i in range(5)]
    assert sorted(map(tuple, coded(spark, few).collect()), key=str) == plain(few)


def test_bounds_save_distances_and_change_nothing(spark):
    rng = random.Random(9)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 16]], 0) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    done = codes.encode(table)
    everything = len(rows) * codes.PARTS * codes.ENTRIES
    assert done.work[0] >= everything and all(w < 0.6 * everything for w in done.work[1:])
    assert sorted(map(tuple, codes.with_label_errors(done).collect()), key=str) == plain(rows)


def test_edges(spark):
    rows = [(1, [1.0] * 8, 1), (None, [2.0] * 8, None), (2, None, 1), (3, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (6, [1.0] * 9, 2), (7, [], 2)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = {r.vec_id: r for r in codes.with_label_errors(codes.encode(table)).collect()}
    assert set(got) == {1, None, 6, 7} and got[1].error == 0 and got[None].label_error == 0
    assert got[6].code is None and got[7].error is None and got[6].label_error is None
    assert codes.with_label_errors(codes.encode(table.where("false"))).collect() == []
    words = codes.with_label_errors(codes.encode(spark.createDataFrame([(i, [float(i)] * 8, "ab"[i % 2]) for i in range(40)], "vec_id int, embedding array<float>, label string"))).collect()
    assert {r.label_error for r in words} == {sum(r.error for r in words if r.vec_id % 2 == k) for k in (0, 1)}
    empty = spark.createDataFrame([(1, [], 0), (2, [], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r)[:3] for r in codes.with_label_errors(codes.encode(empty)).collect()) == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
