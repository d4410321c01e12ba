"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers; their scatter A = n * sum(x x') - s s' is exact, of any size. Its characteristic
polynomial is computed modulo primes (similar Hessenberg form, then the recurrence of its leading minors), a prime a
row of a Spark table, and joined by Chinese remaindering beyond a proven bound. All roots being real, the sign changes
of the polynomial shifted to a point count the roots beyond it exactly: the largest roots are isolated and narrowed by
bisection on whole numbers. A component is the null space of A - root, by inverse iteration in whole-number arithmetic
of a few hundred bits, one root (with its multiplicity) a row of a Spark table again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.sources.scratch import materialize

#: A component becomes floor(SCALE * c); adding a constant to every number changes neither scatter nor deviations.
SCALE = 64
COMPONENTS = 16
#: Binary digits behind the point to which roots are narrowed, relative to the scatter's size in bits.
ROOT_BITS = 128
#: A sum is carried as limbs of so many bits, so that limbs of millions of tasks add up in a long.
LIMB_BITS, LIMBS = 40, 5
#: Vectors beyond it are refused: matrices of dimension x dimension whole numbers are held by the driver and by tasks.
MAX_DIMENSION = 512


# ---- whole-number vectors and their scatter ---------------------------------------------------------------------

def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(SCALE * c) of every vector without null or non-finite entries, of the commonest length.

    Vectors that are null, empty, or of another length than most (ties: the longer) are left out; numbers beyond a
    long are the largest long.
    """
    c = F.col("c")
    good = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("c")).filter(
        c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    sizes = good.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} components")
    return good.filter((F.size("c") == d) & (F.size("c") > 0)).select(
        "vec_id", F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(v: int) -> list[int]:
    """Signed limbs of a whole number, lowest first."""
    sign, v = (-1 if v < 0 else 1), abs(v)
    out = [sign * ((v >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1)) for k in range(LIMBS - 1)]
    return [*out, sign * (v >> (LIMB_BITS * (LIMBS - 1)))]


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x as Python whole numbers."""
    d, size = x.shape[1], max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if size >= 1 << 20:
        y = x.astype(object)
        return y.T @ y
    total = np.zeros((d, d), object)
    step = max(1, (1 << 53) // max(1, size * size))          # so many products add up exactly in a double
    for a in range(0, len(x), min(step, 1 << 13)):
        part = x[a:a + min(step, 1 << 13)].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(d: int):
    """Per task: n, sums and upper triangle of the products, as limbs. Cell d*d is n, d*d + 1 + i the sum of dimension i."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            if len(x):
                most = max(abs(int(x.min())), abs(int(x.max())))
                s = s + (x if most * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)
                p = p + _products(x)
        if n:
            i, j = np.triu_indices(d)
            cells = np.concatenate([i * d + j, [d * d], d * d + 1 + np.arange(d)])
            limbs = np.array([_limbs(int(v)) for v in [*p[i, j], n, *s]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *[pa.array(limbs[:, k]) for k in range(LIMBS)]],
                                             names=["cell", *[f"l{k}" for k in range(LIMBS)]])

    return run


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * sum(x x') - s s') of a column of whole-number vectors, exact."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    cells = (vectors.mapInArrow(_sums(d), "cell long, " + ", ".join(f"{x} long" for x in limbs))
             .groupBy("cell").agg(*[F.sum(x).alias(x) for x in limbs]).collect())    # d(d + 1)/2 + d + 1 rows
    total = {r["cell"]: sum(r[x] << (LIMB_BITS * k) for k, x in enumerate(limbs)) for r in cells}
    n = total.get(d * d, 0)
    s = [total.get(d * d + 1 + i, 0) for i in range(d)]
    a = [[n * total.get(min(i, j) * d + max(i, j), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, a


# ---- the characteristic polynomial ------------------------------------------------------------------------------

def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The ``count`` largest primes below ``below`` (sieved by trial blocks)."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for k in range(2, 257):
        if small[k]:
            small[k * k::k] = False
    base, out, high = np.flatnonzero(small), [], below
    while len(out) < count:
        low = high - (1 << 20)
        block = np.ones(high - low, bool)
        for p in base:
            block[(-low) % p::p] = False
        out += [low + int(k) for k in np.flatnonzero(block)[::-1]]
        high = low
    return out[:count]


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of det(t - a) modulo the prime p < 2^31; ``a`` holds residues."""
    d, h = len(a), a.astype(np.int64) % p
    for k in range(1, d - 1):
        pivot = np.flatnonzero(h[k:, k - 1])
        if not len(pivot):
            continue
        r = k + int(pivot[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        inverse = pow(int(h[k, k - 1]), -1, p)
        factor = h[k + 1:, k - 1] * inverse % p
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k][None, :] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(axis=1)) % p      # the inverse step on columns: similar
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - h[k - 1, k - 1] * minors[k - 1] % p) % p
        beside = 1
        for i in range(1, k):
            beside = beside * int(h[k - i, k - i - 1]) % p
            if not beside:
                break
            minors[k] = (minors[k] - int(h[k - i - 1, k - 1]) * beside % p * minors[k - i - 1] % p) % p
    return [int(c) for c in minors[d]]


def _polynomials(a: list[list[int]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(a, object)
        for batch in batches:
            found = [polynomial_mod((exact % p).astype(np.int64), p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    return run


def characteristic(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first, of det(t - a) for a symmetric matrix of whole numbers without negative roots.

    No coefficient exceeds (1 + trace / d)^d: it is a sum of products of roots, which add up to the trace.
    """
    d = len(a)
    bound = 2 * ((d + sum(a[i][i] for i in range(d))) ** d // d ** d + 1)
    ps = primes(bound.bit_length() // 30 + 1)
    table = spark.createDataFrame([(p,) for p in ps], "p long").repartition(min(len(ps), max(1, spark.sparkContext.defaultParallelism)))
    rows = sorted((r["p"], r["c"]) for r in table.mapInArrow(_polynomials(a), "p long, c array<long>").collect())  # primes x d
    modulus, out = 1, [0] * (d + 1)
    for p, c in rows:
        inverse = pow(modulus, -1, p)
        out = [x + modulus * ((int(y) - x) * inverse % p) for x, y in zip(out, c)]
        modulus *= p
    return [x - modulus if 2 * x > modulus else x for x in out]


def roots_beyond(c: list[int], num: int, bits: int) -> int:
    """How many roots, by multiplicity, of a polynomial with real roots only exceed num / 2^bits: exact.

    It is the number of sign changes of the coefficients around that point (Descartes' rule is exact for real roots).
    """
    d = len(c) - 1
    v = [x << (bits * (d - k)) for k, x in enumerate(c)]     # roots times 2^bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            v[k] += num * v[k + 1]
    signs = [x > 0 for x in v if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(c: list[int], wanted: int, bits: int) -> list[tuple[int, int]]:
    """(root times 2^bits, multiplicity) of the largest positive roots, falling, until ``wanted`` are covered.

    Roots are isolated by counting; those that lie closer than 2^-bits count as one root of their multiplicity.
    """
    c = c[next(k for k, x in enumerate(c) if x):]             # without the roots that are zero
    d, out, n = len(c) - 1, [], 0
    if d:
        for root, m in _falling(c, 1 << abs(c[d - 1]).bit_length(), d, bits):
            out.append((root, m))
            n += m
            if n >= wanted:
                break
    return out


def _sign(c: list[int], num: int, bits: int) -> int:
    """Sign of the polynomial at num / 2^bits."""
    v = 0
    for k, x in enumerate(reversed(c)):
        v = v * num + (x << (bits * k))
    return (v > 0) - (v < 0)


def _falling(c: list[int], top: int, n: int, bits: int) -> Iterator[tuple[int, int]]:
    """The n roots in (0, top], falling, to 2^-bits: found by counts while several are together, by signs once apart."""
    todo = [(0, top, 0, n, 0)]                                # (low, high] in units of 2^-b, roots inside, roots beyond
    while todo:
        low, high, b, n, beyond = todo.pop()
        if n == 1:
            yield _alone(c, low, high, b, bits), 1
            continue
        if high - low <= 1:
            if b == bits:
                yield high, n
                continue
            low, high, b = low << 1, high << 1, b + 1
        mid = (low + high) // 2
        above = roots_beyond(c, mid, b) - beyond
        if n - above:
            todo.append((low, mid, b, n - above, beyond + above))
        if above:
            todo.append((mid, high, b, above, beyond))


def _alone(c: list[int], low: int, high: int, b: int, bits: int) -> int:
    """The one root in (low, high], in units of 2^-bits."""
    right = _sign(c, high, b)
    if not right:
        return high << (bits - b)
    while True:
        while high - low > 1:
            mid = (low + high) // 2
            s = _sign(c, mid, b)
            if not s:
                return mid << (bits - b)
            low, high = (low, mid) if s == right else (mid, high)
        if b == bits:
            return high
        low, high, b = low << 1, high << 1, b + 1


# ---- components -------------------------------------------------------------------------------------------------

def null_vectors(a: list[list[int]], root: int, m: int, bits: int) -> list[list[float]]:
    """``m`` orthonormal vectors of the null space of a - root / 2^bits, by inverse iteration in whole numbers."""
    d = len(a)
    more = bits + 64                                          # digits behind the point of all numbers below
    one = 1 << more
    u = [[(x << more) - ((root << (more - bits)) if i == j else 0) for j, x in enumerate(r)] for i, r in enumerate(a)]
    swaps, factors = [], []
    for k in range(d):
        r = max(range(k, d), key=lambda i: (abs(u[i][k]), -i))
        swaps.append(r)
        u[k], u[r] = u[r], u[k]
        if u[k][k] == 0:
            u[k][k] = 1                                       # singular to the last digit: what inverse iteration wants
        pivot, row, column = u[k][k], u[k], []
        for i in range(k + 1, d):
            f = (u[i][k] << more) // pivot
            column.append(f)
            if f:
                u[i] = [0] * (k + 1) + [x - (f * y >> more) for x, y in zip(u[i][k + 1:], row[k + 1:])]
        factors.append(column)

    def solve(b: list[int]) -> list[int]:
        b = b[:]
        for k in range(d):
            b[k], b[swaps[k]] = b[swaps[k]], b[k]
            for i, f in enumerate(factors[k], k + 1):
                b[i] -= f * b[k] >> more
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - sum(u[k][j] * b[j] >> more for j in range(k + 1, d))) << more) // u[k][k]
        return b

    def unit(v: list[int]) -> list[int]:
        big = max(map(abs, v)).bit_length()
        v = [x << more >> big for x in v] if big > 0 else v
        size = math.isqrt(sum(x * x for x in v))
        return [(x << more) // size for x in v]

    found: list[list[int]] = []
    for k in range(m):
        v = [((i + 1) * (k + 3) * 2654435761 % 1000003 + 1) * (one >> 20) for i in range(d)]
        for _ in range(4):
            v = unit(solve(v))
            for _ in range(2):
                for w in found:
                    dot = sum(x * y for x, y in zip(v, w)) >> more
                    v = [x - (dot * y >> more) for x, y in zip(v, w)]
                v = unit(v)
        big = max(range(d), key=lambda i: (abs(v[i]), -i))
        found.append([-x for x in v] if v[big] < 0 else v)
    return [[x / one for x in v] for v in found]


def _null_spaces(a: list[list[int]], bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [null_vectors(a, int(r), m, bits) for r, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    return run


def components(spark: SparkSession, a: list[list[int]], wanted: int = COMPONENTS) -> tuple[list[float], list[list[float]]]:
    """(roots, unit vectors) of the scatter's largest positive eigenvalues, falling; fewer if fewer are positive."""
    trace = sum(a[i][i] for i in range(len(a)))
    if not a or trace == 0:
        return [], []
    bits = max(0, ROOT_BITS - trace.bit_length()) + ROOT_BITS
    found = largest_roots(characteristic(spark, a), wanted, bits)
    table = spark.createDataFrame([(k, str(r), m) for k, (r, m) in enumerate(found)], "k int, r string, m int")
    rows = table.repartition(len(found)).mapInArrow(_null_spaces(a, bits), "k int, v array<array<double>>").collect()
    vectors = {r["k"]: r["v"] for r in rows}                  # components x d numbers
    roots = [r / (1 << bits) for r, m in found for _ in range(m)]
    return roots[:wanted], [v for k in range(len(found)) for v in vectors[k]][:wanted]


# ---- whitened rows ----------------------------------------------------------------------------------------------

def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exact: longs where they suffice, else Python's whole numbers."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, s), default=0)
    if most < 1 << 62:
        return x * np.int64(n) - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def _projected(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Centred rows on the scaled components, by products of a row alone, whatever rows stand beside it."""
    out, c = np.zeros((len(c), len(w))), c.astype(np.float64)
    for k in range(len(w)):
        out[:, k] = (c * w[k]).sum(axis=1)
    return out


def _whiten(n: int, s: list[int], w: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centred(_matrix(batch.column(1), len(s)), n, s)
            small = not c.size or max(abs(int(c.min())), abs(int(c.max()))) ** 2 * len(s) < 1 << 62
            deviation = (c * c).sum(axis=1) if small else (c.astype(object) ** 2).sum(axis=1)
            out = _projected(c, w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(v) for v in deviation.tolist()], pa.string()),
                 pa.array(list(out), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return run


def _spread(n: int, s: list[int], w: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            out = _projected(_centred(_matrix(batch.column(0), len(s)), n, s), w)
            sums += out.sum(axis=0)
            products += out.T @ out
        yield pa.RecordBatch.from_arrays([pa.array([[*sums, *products.ravel()]], pa.list_(pa.float64()))], names=["v"])

    return run


def identity_error(distinct: DataFrame, n: int, s: list[int], w: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, to 12 decimals."""
    k = len(w)
    parts = distinct.mapInArrow(_spread(n, s, w), "v array<double>")
    total = np.array([r["t"] for r in parts.select(F.posexplode("v").alias("at", "x")).groupBy("at")
                      .agg(F.sum("x").alias("t")).orderBy("at").collect()])              # k + k * k rows
    mean, products = total[:k] / n, total[k:].reshape(k, k) / n
    return round(float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max()), 12)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per vector: vec_id, n, deviation decimal(38,0), whitened (one number a component), explained (one
    share a component), identity_error.

    Fitted to every distinct whole-number vector once (see :func:`whole_vectors` for what takes no part). Components
    are those of positive eigenvalues, falling, ``wanted`` at most: fewer where the vectors span less, none (empty
    arrays, error 0) if all are equal. Equal eigenvalues get some orthonormal vectors of their space. Repeated rows and
    ids each get their row; an empty table gives an empty result; other columns are not read. A deviation beyond 38
    digits is null.
    """
    spark = rows.sparkSession
    kind = rows.schema[vec_id].dataType.simpleString()
    all_x = materialize(whole_vectors(rows, vec_id, vector), "whitening-vectors")
    distinct = materialize(all_x.select("x").dropDuplicates(["x"]), "whitening-distinct")
    one = distinct.first()
    d = len(one["x"]) if one else 0
    n, s, a = scatter(distinct, d) if d else (0, [], [])
    roots, vectors = components(spark, a, wanted)
    trace = sum(a[i][i] for i in range(d))
    w = np.array([[x / math.sqrt(r) for x in v] for r, v in zip(roots, vectors)]).reshape(len(roots), d)
    error = identity_error(distinct, n, s, w) if len(roots) else 0.0
    found = all_x.select("vec_id", "x").mapInArrow(_whiten(n, s, w), f"vec_id {kind}, deviation string, whitened array<double>")
    return found.select(
        "vec_id", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened",
        F.array(*[F.lit(r / trace) for r in roots]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
