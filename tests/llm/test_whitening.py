from __future__ import annotations

import math

import numpy as np
import pytest

from factloom.llm import catalog, whitening

SMALL = "/root/testdata/sf0.001"


def brute_force(vectors, wanted=32):
    """Whole numbers, eigenvalues (falling), eigenvectors, exact deviations and the trace."""
    kept = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    c = (x - np.array([b / n for b in s], dtype=object)).astype(float)
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return c, values[::-1][:wanted], axes[:, ::-1][:, :wanted], deviations, np.trace(v)


def as_matrix(rows, ids, column):
    k = max(r.component for r in rows)
    at = {i: j for j, i in enumerate(ids)}
    out = np.zeros((len(ids), k))
    for r in rows:
        out[at[r[0]], r.component - 1] = r[column]
    return out


def test_query_equals_a_full_decomposition(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    c, values, axes, deviations, trace = brute_force([r.embedding for r in table])
    rows = catalog.op12_whitening(spark, SMALL).collect()
    ids = [r.vec_id for r in table]
    assert len(rows) == 32 * len(ids) == 16_000 and {r.n for r in rows} == {len(ids)}
    got = as_matrix(rows, ids, "whitened")
    want = c @ axes / np.sqrt(values)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-8
    assert {r.vec_id: r.deviation for r in rows} == dict(zip(ids, deviations, strict=True))
    shares = {r.component: r.explained for r in rows}
    assert np.allclose([shares[k + 1] for k in range(32)], values / trace, rtol=1e-10)
    assert max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5) * 3]) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1])]
    odd = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [1.0, float("nan"), 0.0, 0.0, 0.0]), (93, [float("inf")] + [0.0] * 4), (94, []), (95, [1.0, 2.0]), (96, [1e30] + [0.0] * 4)]
    docs = spark.createDataFrame([(i, v, 1, "x", [2]) for i, v in [*rows, *odd]], "vec_id long, embedding array<float>, component int, id string, x array<int>").repartition(5)
    got = whitening.whiten(docs).collect()
    narrow = [[float(np.float32(c)) for c in v] for _, v in rows]
    _, values, _, deviations, trace = brute_force(narrow)
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {len(rows)}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), values / trace, rtol=1e-12)


def test_few_directions_and_no_rows(spark):
    kind = "vec_id int, embedding array<double>"
    line = [(i, [i * 1.0, 2.0 * i, 0.0]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(line, kind)).collect()
    assert len(got) == 10 and got[0].component == 1 and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("block", [1, 4, 16])
def test_lanczos_on_spectra_that_break_down(block):
    rng = np.random.default_rng(2)
    spectra = {
        "copies": np.array([9.0] * 11 + [4.0] * 30 + [1.0] * 19),
        "one": np.array([5.0] + [0.0] * 59),
        "all equal": np.full(60, 3.0),
        "falling": 1.7 ** -np.arange(60.0),
        "zero": np.zeros(60),
        "plain": np.sort(rng.uniform(0, 10, 60))[::-1],
    }
    for name, values in spectra.items():
        q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
        v = q @ np.diag(values) @ q.T
        passes = []
        got, axes = whitening.lanczos(lambda b: (passes.append(1), v @ b)[1], 60, 20, block)  # noqa: B023
        scale = max(values[0], 1e-300)
        assert np.abs(got - values[:20]).max() <= 1e-12 * scale, name
        assert np.abs(axes.T @ axes - np.eye(20)).max() < 1e-12, name
        assert np.abs(v @ axes - axes * got).max() <= 1e-11 * scale, name
        assert len(passes) <= -(-60 // block) + 1


def test_lanczos_stops_before_the_space_is_spanned():
    rng = np.random.default_rng(3)
    values = np.concatenate([np.linspace(100, 50, 8), rng.uniform(0, 0.01, 992)])
    q = np.linalg.qr(rng.normal(size=(1000, 1000)))[0]
    v = (q * values) @ q.T
    passes = []
    got, _ = whitening.lanczos(lambda b: (passes.append(1), v @ b)[1], 1000, 8, 16)
    assert np.allclose(got, values[:8], rtol=1e-12) and len(passes) < 12


def test_deviations_beyond_64_bits():
    x = np.array([[2_000_000, 1_000_000], [1_000_000, 1_000_000]])
    n = 4_000
    base, rest = np.array([1_000_001, 1_000_000]), [7, 0]
    got, about = whitening._deviations(x, n, base, rest)
    whole = [sum((n * (int(a) - int(b)) - r) ** 2 for a, b, r in zip(row, base, rest, strict=True)) for row in x]
    assert got == [w if w < 1 << 63 else None for w in whole] and got[0] is None and got[1] is not None
    assert np.allclose(about, [float(w) for w in whole], rtol=1e-12)
