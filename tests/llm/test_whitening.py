import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import registry, whitening
from quernstone.llm.whitening import OFFSET, SCALE

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(rows):
    """n, sums and covariance of integer rows in whole numbers, rounded at the end."""
    n, width = len(rows), len(rows[0])
    s = [sum(r[j] for r in rows) for j in range(width)]
    v = [[float(Fraction(n * sum(r[i] * r[j] for r in rows) - s[i] * s[j], n * n)) for j in range(width)] for i in range(width)]
    return n, s, np.array(v)


def ints(vec, width=None):
    x = [math.floor(SCALE * float(np.float32(c))) + OFFSET for c in vec]
    return x + [OFFSET] * ((width or len(x)) - len(x))


def test_two_sum_and_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=1000) * 10.0 ** rng.integers(-20, 20, 1000), rng.normal(size=1000)
    s, e = whitening.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(p) + Fraction(q) for x, y, p, q in zip(a, b, s, e))
    hi, lo = whitening.column_sums(np.array([[1e30], [1.0], [-1e30], [2.0**-60]]))
    assert Fraction(hi[0]) + Fraction(lo[0]) == 1 + Fraction(1, 2**60)


@pytest.mark.parametrize("spread", [1e-3, 1.0, 1e6])
def test_covariance_is_correctly_rounded(spark, spread):
    """A mean of 1e9 times the spread: the textbook formula loses all digits here."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(700, 5)) * 1e6 * spread + rng.normal(size=5) * 1e15 * min(1.0, spread))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(7)
    got = whitening.moments(rows, whitening.finite_rows)
    n, s, v = exact([[int(c) for c in r] for r in x])
    assert (got.n, got.sums) == (n, s)
    assert (got.covariance == v).all()


def test_block_products_are_exact():
    """Integers of 40 bits: 4096 products of each need 92 bits, which a pair holds."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.uniform(-(2.0**40), 2.0**40, (whitening.BLOCK_ROWS, 3)))
    hi, lo = whitening.outer_products((x, np.zeros_like(x)))
    whole = [[int(c) for c in r] for r in x]
    for i in range(3):
        for j in range(3):
            assert Fraction(hi[i, j]) + Fraction(lo[i, j]) == sum(r[i] * r[j] for r in whole)


def checked(rows, vectors, most=8):
    """Compare with whole-number covariance and its eigenvectors."""
    width = max(map(len, vectors.values()))
    n, s, v = exact([ints(x, width) for x in vectors.values()])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * min(most, width)
    z = np.zeros((len(vectors), min(most, width)))
    for k, (i, vec) in enumerate(vectors.items()):
        x = ints(vec, width)
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for c in range(z.shape[1]):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, min(deviation, (1 << 63) - 1))
            assert r.explained == pytest.approx(values[c] / np.trace(v), rel=1e-9)
            z[k, c] = r.whitened
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(ints(x, width), s)] for x in vectors.values()])
    want = centred @ axes[:, : z.shape[1]] / np.sqrt(values[: z.shape[1]])
    want *= np.sign((want * z).sum(0))
    assert np.abs(z - want).max() < 1e-8
    error = np.abs(np.cov(z.T, bias=True).reshape(z.shape[1], -1) - np.eye(z.shape[1])).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-9 and abs(rows[0].identity_error - error) < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=12) * np.arange(1, 13)).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), SCHEMA).repartition(5).selectExpr("*", "1 as id", "2 as n", "3 as deviation")
    checked(whitening.whiten(df).collect(), vectors)


def test_query(spark, sf_dir):
    rows = registry.QUERIES["op11_whitening"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in table if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    checked(rows, vectors)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, None), (3, [nan, 1.0, 1.0]), (4, [1.0, inf, 1.0]), (5, [1.0, None, 1.0]),
        (None, [4.0, 0.0, 1.0]), (6, [1.0]), (7, []), (8, [0.5, -3.0, 2.0]), (9, [-1.0, 1.0, 0.25]),
    ]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    # repeated, null, short and empty vectors take part
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id is not None) == sorted((i, c) for i in (1, 1, 6, 7, 8, 9) for c in (1, 2, 3))
    assert {r.n for r in got} == {7} and len(got) == 21
    kept = [ints(v, 3) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, s, v = exact(kept)
    explained = {r.component: r.explained for r in got}
    assert sum(explained.values()) == pytest.approx(1.0) and explained[1] == pytest.approx(np.linalg.eigvalsh(v)[-1] / np.trace(v))
    assert got[0].identity_error < 1e-9


def test_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries(spark):
    """Deviations beyond a long and entries beyond 2**52 stay at the ends."""
    rows = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got} == {(1 << 63) - 1} and len(got) == 8
    x = np.array([[1e9, 5.0], [2.0, 7.0]])
    s = [int(c) for c in x.sum(0)]
    assert whitening.deviations(x, 2, s).tolist() == [sum((2 * int(c) - t) ** 2 for c, t in zip(r, s)) for r in x]


def test_other_types(spark):
    rows = spark.createDataFrame([("a", [1, 2]), ("b", [5, 9]), ("c", [0, 1])], "vec_id string, embedding array<int>")
    assert whitening.whiten(rows).count() == 6


def test_finite_rows_of_slices():
    column = pa.array([[1.0, 2.0], None, [3.0], [None], [], [float("nan")], [4.0, 5.0]], pa.list_(pa.float32()))
    at, rows = whitening.finite_rows(column.slice(2, 5))
    assert at.tolist() == [0, 2, 4] and rows.tolist() == [[3.0, 0.0], [0.0, 0.0], [4.0, 5.0]]
