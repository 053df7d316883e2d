"""Bit planes, exact sums and whitened values against plain integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import whitening

INT64 = st.integers(-(2**63), 2**63 - 1)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def exact(rows):
    """(distinct integer vectors, S, covariance as fractions)."""
    fit = sorted({tuple(math.floor(256 * c) for c in v) for v in rows})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    cov = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(dims)] for i in range(dims)]
    return fit, s, cov


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.lists(st.lists(st.one_of(st.integers(-200, 200), INT64), min_size=d, max_size=d), min_size=1, max_size=9)))
def test_products_of_a_block_are_exact(rows):
    x = np.array(rows, dtype=np.int64)
    sums, products = whitening.block_products(x)
    dims = x.shape[1]
    assert sums == [sum(r[d] for r in rows) for d in range(dims)]
    for i in range(dims):
        assert products[i][i:] == [sum(r[i] * r[j] for r in rows) for j in range(i, dims)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(INT64, min_size=3, max_size=3), min_size=1, max_size=20))
def test_packed_rows_come_back(rows):
    x = np.array(rows, dtype=np.int64)
    packed = whitening.packed(x)
    assert (whitening.unpacked(packed, 3) == x).all()
    assert len(set(packed)) == len({tuple(r) for r in rows})


@given(st.integers(-(2**140), 2**140))
def test_limbs_add_up(value):
    assert sum(part << (32 * limb) for limb, part in whitening._limbs(value)) == value


def check(got, rows):
    """``got``: Spark's rows for ``rows`` of (id, vector), none of them dropped."""
    fit, s, cov = exact([v for _, v in rows])
    n, v = len(fit), np.array([[float(c) for c in r] for r in cov])
    trace = float(sum(cov[d][d] for d in range(len(s))))
    assert len(got) == len(rows)
    by_id = {r["vec_id"]: r["whitening"] for r in got}
    values, vectors = np.linalg.eigh(v)
    k = min(4, int((values > trace * 1e-12).sum()))
    for i, vector in rows:
        w, x = by_id[i], [math.floor(256 * c) for c in vector]
        assert w["n"] == n and w["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert len(w["whitened"]) == len(w["explained"]) == k and w["identity_error"] <= 1e-4
        assert np.allclose(w["explained"], values[::-1][:k] / trace, rtol=1e-9)
        centred = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s)])
        want = centred @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
        assert np.allclose(np.abs(w["whitened"]), np.abs(want), atol=1e-8)
    # the covariance of the whitened fit list is the identity
    first = {tuple(math.floor(256 * c) for c in v): by_id[i]["whitened"] for i, v in rows}
    white = np.array([first[x] for x in fit])
    white = white - white.mean(axis=0)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8


def random_rows(seed, n, dims):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)) @ np.diag(np.linspace(3, 0.1, dims)) @ r.standard_normal((dims, dims)) / 8
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, dims", [(300, 12), (5000, 5), (40, 3), (3, 8)])
def test_whole_tables(spark, n, dims):
    rows = random_rows(n, n, dims)
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # copies are fitted once
    check(whitening.whiten(table(spark, rows).repartition(3)).collect(), rows)


def test_wide_values(spark):
    """Entries far apart leave 64 bits in sums, products and deviations."""
    r = np.random.default_rng(1)
    rows = [(i, [float(c) for c in r.standard_normal(3) * [1e9, 1e4, 1.0]]) for i in range(60)]
    fit, s, cov = exact([v for _, v in rows])
    got = whitening.whiten(table(spark, rows, "double")).collect()
    by_id = {x["vec_id"]: x["whitening"] for x in got}
    for i, v in rows:
        assert by_id[i]["deviation"] == sum((len(fit) * math.floor(256 * c) - b) ** 2 for c, b in zip(v, s))
        assert by_id[i]["explained"][0] == pytest.approx(1.0)


def test_odd_rows_go_and_columns_stay(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(2, 50, 4)
    odd = [(100, None), (101, []), (102, [nan, 1.0, 1.0, 1.0]), (103, [-inf, 1.0, 1.0, 1.0]), (104, [None, 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [3e38] * 4)]
    df = table(spark, rows + odd + [(None, [-0.0] * 4), (7, rows[7][1])])
    named = df.selectExpr("*", "'kept' AS whitening", "'kept' AS x", "'kept' AS i")
    got = whitening.whiten(named).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted([(False, i) for i, _ in rows] + [(False, 7), (True, 0)])
    assert {r["x"] for r in got} == {"kept"} and got[0]["whitening"]["n"] == len(exact([v for _, v in rows] + [[0.0] * 4])[0])


def test_without_variance_or_rows(spark):
    equal = whitening.whiten(table(spark, [(i, [0.25, -0.5]) for i in range(5)])).collect()
    assert [(r["whitening"]["n"], r["whitening"]["deviation"], r["whitening"]["whitened"]) for r in equal] == [(1, 0, [])] * 5
    line = whitening.whiten(table(spark, [(i, [float(i), 0.0]) for i in range(5)])).collect()
    assert {len(r["whitening"]["whitened"]) for r in line} == {1}
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []
