import math
import random

import numpy as np
import pytest

from doctree.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key long, id long, v string, score long, grp long"


def brute(rows, every=100, k=5, most=10):
    """The contract, pair by pair, on (id, vector, label)."""
    held = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(held):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, lab) for b, (j, w, lab) in enumerate(held) if b != a]
        order = lambda r: (-r[0], r[1] is None, r[1] or 0)
        for p, j, _ in sorted((r for r in scored if r[2] == label), key=order)[:k]:
            inside = sorted((r for r in scored if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p), key=order)[:most]
            out += [(i, j, n, x[1], p, x[0]) for n, x in enumerate(inside, 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 1, 2, "v", 3, 4) for i, v, lab in rows], SCHEMA).repartition(3)
    return df.select(df["vec_id"], df["embedding"], hn.relabelled(df["vec_id"], df["label"].cast("long")).alias("label"), "key", "score", "grp")


def vectors(seed, n, d, spread=1.0):
    r = np.random.default_rng(seed)
    base = r.standard_normal(d)
    return [(i, (spread * r.standard_normal(d) / np.sqrt(d) + (0.5 * base if i % 3 else 0)).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("block", "level_rows", "growth"), [(4096, 1 << 16, 16), (3, 50, 3), (1, 400, 2)])
def test_equals_brute_force_in_any_blocks_and_levels(spark, block, level_rows, growth):
    rows = vectors(1, 700, 12)
    got = hn.mine_hard_negatives(frame(spark, rows), block=block, level_rows=level_rows, growth=growth)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 200 and sorted(map(tuple, got.collect()), key=repr) == want


def test_nulls_ties_repeats_short_and_hot_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, 0.25, -0.125, 0.5]
    rows = [(i, same, i % 2) for i in range(0, 400, 2)]  # a hot vector: only ids tell rows apart
    rows += [(i, [0.25, 0.2, 0.1, 0.3 + i / 1000], i % 3) for i in range(1, 120, 2)]
    rows += [(None, same, 1), (None, [0.3, 0.2], 0), (100, same, 0), (100, [0.3, 0.1, 0.0, 0.2], 1), (700, [], 1), (701, None, 1), (702, same, None), (703, [nan, 1.0, 1.0, 1.0], 0), (704, [inf, 1.0, 1.0, 1.0], 0), (705, [None, 1.0, 1.0, 1.0], 0), (-100, [0.2, 0.3, 0.1, 0.5], 2)]
    got = sorted(map(tuple, hn.mine_hard_negatives(frame(spark, rows), block=2, level_rows=100, growth=2).collect()), key=repr)
    want = brute(rows)
    assert got == want and want
    empty = frame(spark, rows).limit(0)
    assert hn.mine_hard_negatives(empty).collect() == []
    assert hn.mine_hard_negatives(frame(spark, [(1, None, 1), (100, None, 2)])).collect() == []
    assert hn.mine_hard_negatives(frame(spark, [(100, [], 1), (200, [], 1)])).collect() == []


def test_bounds_never_lose_a_pair_and_discard_most():
    r = np.random.default_rng(5)
    scale = 0.8 ** np.arange(32)
    a, b = (np.floor(256 * r.standard_normal((n, 32)) * scale).astype(np.int64) for n in (20, 500))
    turn = np.linalg.qr(r.standard_normal((32, 32)))[0]
    turn = np.linalg.eigh((b @ turn).T @ (b @ turn))[1][:, ::-1].T @ turn.T
    x, y = hn.Rotated(a, turn.T), hn.Rotated(b, turn.T)
    exact = a @ b.T
    low, high = np.quantile(exact, 0.95, axis=1), np.quantile(exact, 0.99, axis=1)
    i, j, score = hn.surviving(x, y, np.ones(exact.shape, bool), low, high)
    want = {(p, q) for p in range(20) for q in range(500) if low[p] <= exact[p, q] <= high[p]}
    assert set(zip(i.tolist(), j.tolist())) == want and (exact[i, j] == score).all()
    first = x.steps[0]
    part, rest = x.turned[:, :first] @ y.turned[:, :first].T, np.outer(x.rest[first], y.rest[first])
    assert ((part + rest >= low[:, None]) & (part - rest <= high[:, None])).mean() < 0.5


def test_the_rotation_keeps_products(spark):
    rows = vectors(3, 200, 8)
    found = hn.integer_vectors(frame(spark, rows), "vec_id", "embedding", "label")
    turn = hn.rotation(found, 8)
    assert np.allclose(turn @ turn.T, np.eye(8), atol=1e-10)
