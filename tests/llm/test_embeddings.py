import numpy as np
import pytest

from colophon.llm import embedding_dedup as emb


def brute(rows, cosine):
    def sound(r):
        v = r[1]
        return r[2] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [sound(r) for r in rows]
    x = [np.array(r[1], np.float32).astype(float) if g else None for r, g in zip(rows, good)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(emb, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 32))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(32) * rng.choice([0.03, 0.12, 0.16, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 6 // 3)))
    rows += [(300 + i, rows[4][1], 0) for i in range(5)] + [(400, (np.array(rows[4][1]) * 2).tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = emb.embedding_dedup(frame).collect()
    assert sorted(map(tuple, got)) == brute(rows, 0.98)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [], 0), (9, [1.0, None], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1), (12, [-1.0, 0.0], 0)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rid int, weight int")
    assert sorted(map(tuple, emb.embedding_dedup(frame).collect())) == brute(rows, 0.98)
    assert emb.embedding_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e307, 5e-310])
def test_very_large_and_small_components(spark, scale):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [scale, 2 * scale, 3 * scale], 0), (3, [3 * scale, 2 * scale, scale], 0), (4, [scale, 2 * scale, 3.01 * scale], 0)]
    got = emb.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


def test_every_planted_link_of_many_vectors_is_found(spark):
    """4 000 vectors of one label, half of them near copies at cosines around the threshold: all links, none else."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2000, 64))
    copy = base + rng.standard_normal((2000, 64)) * rng.uniform(0.05, 0.25, (2000, 1))
    x = np.concatenate([base, copy]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in emb.embedding_dedup(rows.repartition(4)).collect()}
    assert [got[i] for i in range(len(x))] == linked.sum(axis=1).tolist() and linked.sum() > 1500


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    errors, held = [], 0
    for _ in range(40):
        x = rng.standard_normal((50, 64))
        x[25:] = x[:25] + rng.standard_normal((25, 64)) * 0.3
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        code, factor, eight, step = emb.encode(unit)
        cosines = unit @ unit.T
        signs = np.unpackbits(code, axis=1)[:, :64] * 2.0 - 1
        estimate = signs @ eight.T * step[None, :] / 8 / factor[:, None]
        off = ~np.eye(50, dtype=bool)
        errors.append((estimate - cosines)[off].mean())
        held += (emb.upper_bounds(code, factor, eight, step) >= cosines)[off].mean()
    assert abs(np.mean(errors)) < 0.005 and held / 40 > 0.9999


def test_bands_miss_few():
    for n in (10, 1000, 10**6, 10**9):
        bits, bands = emb.plan_bands(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** bands <= 1e-6
