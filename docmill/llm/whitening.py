"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter of all vectors is an integer matrix that
tasks sum up without rounding. Its characteristic polynomial is worked out
modulo primes of 31 bits, a few primes a task (reduction to Hessenberg form),
and put together by Chinese remaindering. All its roots are real and not
negative, so that the sign changes of the shifted polynomial count the roots
above a point exactly; bisection with these counts isolates the largest
eigenvalues and tells their multiplicities. A component comes from one step of
inverse iteration into the null space, in integers with as many bits as the
distance to the next eigenvalue asks for; each eigenvalue is a row of a small
table whose rows are worked in parallel.

The driver holds tables of the vectors' dimension only: the scatter, the
polynomial and the components.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c counts as the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: floor(SCALE * c) is held within this bound on either side.
HELD = 1 << 62
#: Bits of the pieces that an entry is cut into, and rows whose pieces are multiplied at once: sums stay below 2^53.
LIMB_BITS, BLOCK = 20, 4096
#: Blocks after which a task passes on what it has summed.
FLUSH = 256
#: The driver holds the square of so many numbers at most.
MOST_DIMENSIONS = 2048
#: Bits by which an eigenvalue is known better than its distance to the next one, and than itself.
GUARD_BITS = 100


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with ``sums`` (of entries less :data:`SHIFT`); unit ``components`` as rows, their ``variances`` and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, vec`` of the rows that take part, and their dimension.

    Rows go whose vector is null, empty, or holds null or non-finite entries, and
    those whose length isn't the most frequent one (of equally frequent ones the longest).
    """
    rows = df.select(df[id_col].alias("vec_id"), df[vec_col].cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter((F.size("vec") > 0) & finite)
    first = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = first["d"] if first else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} entries; at most {MOST_DIMENSIONS} are supported")
    return rows.filter(F.size("vec") == d), d


def entries(column: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * c) of each entry, one row a vector."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -float(HELD), float(HELD)).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed pieces of LIMB_BITS bits, the low ones first, whose products are exact in doubles."""
    sign, rest, out = np.sign(y), np.abs(y), []
    while not out or rest.any():
        out.append((sign * (rest & ((1 << LIMB_BITS) - 1))).astype(np.float64))
        rest = rest >> LIMB_BITS
    return out


def scatter(rows: DataFrame, d: int) -> list[list[int]]:
    """Exact sums of products of all pairs of entries; the last row and column are those of a constant 1."""
    upper = np.triu_indices(d + 1)

    def parts(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for w, total in sums.items():
            value = total[upper]
            held = np.flatnonzero(value)
            columns = [pa.array(upper[0][held], pa.int32()), pa.array(upper[1][held], pa.int32()), pa.array(np.full(len(held), w), pa.int32()), pa.array(value[held])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "w", "value"])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        blocks = 0
        for batch in batches:
            y = entries(batch.column(0), d)
            for k in range(0, len(y), BLOCK):
                pieces = limbs(y[k : k + BLOCK])
                pieces = [np.hstack([x, np.full((len(x), 1), float(not w))]) for w, x in enumerate(pieces)]
                for a, x in enumerate(pieces):
                    for b, z in enumerate(pieces):
                        sums[a + b] = sums.get(a + b, 0) + (x.T @ z).astype(np.int64)
                blocks += 1
                if blocks % FLUSH == 0:
                    yield from parts(sums)
                    sums = {}
        yield from parts(sums)

    found = rows.select("vec").mapInArrow(run, "i int, j int, w int, value bigint")
    total = found.groupBy("i", "j", "w").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in total.collect():
        out[r["i"]][r["j"]] += int(r["value"]) << (LIMB_BITS * r["w"])
    for i in range(d + 1):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def is_prime(p: int) -> bool:
    """Exact for numbers of 32 bits."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7, 61)):
        return p in (2, 3, 5, 7, 61)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 7, 61):
        x = pow(a, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes() -> Iterator[int]:
    """The primes of 31 bits, the largest first."""
    return (p for p in range((1 << 31) - 1, 1 << 30, -2) if is_prime(p))


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` that is zero below its first subdiagonal."""
    h = a % p
    for k in range(1, len(h) - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo ``p``, the leading one first."""
    d, h = len(a), hessenberg(a, p)
    minors = np.zeros((d + 1, d + 1), np.int64)  # of leading blocks, by rising powers
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weights[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d, ::-1]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - m) of a positive semidefinite integer matrix, the leading one first."""
    d, mean = len(m), -(-sum(m[i][i] for i in range(len(m))) // len(m))
    bound, product, chosen = 2 * max(math.comb(d, k) * mean**k for k in range(d + 1)), 1, []
    for p in primes():
        if product > bound:
            break
        chosen.append(p)
        product *= p

    def run(batches):
        for batch in batches:
            ps = batch.column(0).to_pylist()
            rows = [polynomial_modulo(np.array([[x % p for x in row] for row in m], np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["p", "c"])

    asked = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(min(len(chosen), spark.sparkContext.defaultParallelism))
    out, product = [0] * (d + 1), 1
    for r in asked.mapInArrow(run, "p bigint, c array<bigint>").collect():
        p = r["p"]
        inverse = pow(product, -1, p)
        out = [x + product * ((c - x) * inverse % p) for x, c in zip(out, r["c"], strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def _reduced(c: list[int], p: int) -> list[int]:
    c = [x % p for x in c]
    return c[next((i for i, x in enumerate(c) if x), len(c)) :]


def _common(f: list[int], g: list[int], p: int) -> list[int]:
    """The monic greatest common divisor modulo ``p``."""
    f, g = _reduced(f, p), _reduced(g, p)
    while g:
        inverse = pow(g[0], -1, p)
        while len(f) >= len(g):
            by = f[0] * inverse % p
            f = _reduced([x - by * y for x, y in zip(f, g + [0] * (len(f) - len(g)), strict=True)], p)
        f, g = g, f
    inverse = pow(f[0], -1, p)
    return [x * inverse % p for x in f]


def _divided(f: list[int], g: list[int]) -> tuple[list[int], bool]:
    """Quotient of integer polynomials, ``g`` monic, and whether nothing remains."""
    f, out = list(f), []
    for k in range(len(f) - len(g) + 1):
        out.append(f[k])
        for i, y in enumerate(g):
            f[k + i] -= out[-1] * y
    return out, not any(f)


def simple_roots(f: list[int]) -> list[int]:
    """The monic polynomial with the same roots, each once."""
    d = len(f) - 1
    slope = [x * (d - k) for k, x in enumerate(f[:-1])]
    held, product = None, 1
    for p in primes():
        g = _common(f, slope, p)
        if len(g) == 1:
            return f
        if held is None or len(g) < len(held):
            held, product = g, p
        elif len(g) == len(held):
            inverse = pow(product, -1, p)
            held = [x + product * ((c - x) * inverse % p) for x, c in zip(held, g, strict=True)]
            product *= p
        signed = [x - product if 2 * x > product else x for x in held]
        quotient, exact = _divided(f, signed)
        if exact and _divided(slope, signed)[1]:
            return quotient
    raise ArithmeticError("no prime left")


def roots_above(f: list[int], num: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only, each as often as it counts, are above num / 2^bits."""
    num, bits = num << max(0, -bits), max(0, bits)
    c = [x << (bits * k) for k, x in enumerate(f)]
    n = len(c)
    for end in range(n, 1, -1):
        for k in range(1, end):
            c[k] += num * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(f: list[int], num: int, bits: int) -> int:
    """The sign of f at num / 2^bits is that of the result."""
    num, bits, out = num << max(0, -bits), max(0, bits), 0
    for k, x in enumerate(f):
        out = out * num + (x << (bits * k))
    return out


@dataclass(frozen=True)
class Root:
    """The root of ``rank`` (0: the largest) lies in (lo, lo + 1] / 2^bits."""

    rank: int
    lo: int
    bits: int

    def halved(self, f: list[int]) -> Root:
        lo, bits = 2 * self.lo, self.bits + 1
        value = _value(f, lo + 1, bits)
        at_or_below = value == 0 or (value > 0) == (self.rank % 2 == 0)
        return Root(self.rank, lo if at_or_below else lo + 1, bits)

    def until(self, f: list[int], bits: int) -> Root:
        out = self
        while out.bits < bits:
            out = out.halved(f)
        return out

    def low(self) -> Fraction:
        return Fraction(self.lo, 1 << self.bits) if self.bits >= 0 else Fraction(self.lo << -self.bits)

    def high(self) -> Fraction:
        return self.low() + (Fraction(1, 1 << self.bits) if self.bits >= 0 else Fraction(1 << -self.bits))


def isolate(f: list[int], above: int, most: int) -> list[Root]:
    """The ``most`` largest roots of ``f`` (simple, real, in (0, above]), largest first, each in an interval of its own."""
    top = above.bit_length()
    # Points are counted on the grid of halves, which starts with the whole interval.
    counted: dict[tuple[int, int], int] = {}

    def count(num: int, bits: int) -> int:
        if (num, bits) not in counted:
            counted[num, bits] = roots_above(f, num, bits)
        return counted[num, bits]

    out, todo = [], [(0, -top)]
    while todo and len(out) < most:
        lo, bits = todo.pop()
        above_lo, above_hi = count(lo, bits), count(lo + 1, bits)
        if above_lo - above_hi == 1:
            out.append(Root(above_hi, lo, bits))
        elif above_lo > above_hi:
            todo += [(2 * lo, bits + 1), (2 * lo + 1, bits + 1)]
    return out


def parted(f: list[int], roots: list[Root], least: Fraction | None) -> list[tuple[Root, Fraction]]:
    """Each root with a lower bound of its distance to the others, and to ``least`` if given; intervals shrink until bounds are positive."""
    out, gaps = list(roots), []
    for k in range(len(out)):
        while k + 1 < len(out):
            gap, width = out[k].low() - out[k + 1].high(), max(out[k].high() - out[k].low(), out[k + 1].high() - out[k + 1].low())
            if gap > width:
                break
            out[k], out[k + 1] = out[k].halved(f), out[k + 1].halved(f)
        if k + 1 == len(out) and least is not None:
            while out[k].low() <= least:
                out[k] = out[k].halved(f)
            gap = out[k].low() - least
        elif k + 1 == len(out):
            gap = gaps[-1] if gaps else Fraction(1)
        gaps.append(gap)
    return [(r, min(gaps[k], gaps[k - 1] if k else gaps[k])) for k, r in enumerate(out)]


def null_space(m: list[list[int]], near: Fraction, bits: int, count: int) -> np.ndarray:
    """``count`` orthonormal vectors of the eigenspace at ``near``, which is no eigenvalue but within 2^(1 - bits) of one.

    One step of inverse iteration from seeded vectors: elimination with row
    interchanges in integers of 128 more bits.
    """
    d, one = len(m), bits + 128
    a = np.array([[x << one for x in row] for row in m], object)
    shift = math.floor(near * (1 << one))
    for i in range(d):
        a[i, i] -= shift
    rnd, kept = random.Random(d), []
    b = np.array([[rnd.randrange(1 << 24, 1 << 25) << one for _ in range(count)] for _ in range(d)], object)
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, r]], b[[k, r]] = a[[r, k]], b[[r, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        by = np.array([(x << one) // a[k, k] for x in a[k + 1 :, k]], object)
        if len(by):
            a[k + 1 :, k + 1 :] -= (by[:, None] * a[k, k + 1 :]) >> one
            b[k + 1 :] -= (by[:, None] * b[k]) >> one
    x = np.zeros((d, count), object)
    for k in range(d - 1, -1, -1):
        rest = b[k] - ((a[k, k + 1 :, None] * x[k + 1 :]).sum(axis=0) >> one) if k + 1 < d else b[k]
        x[k] = [(v << one) // a[k, k] for v in rest]
    for c in range(count):
        v = x[:, c]
        for u in kept:
            v = v - ((u * ((u * v).sum() >> 256)) >> 256)
        length = math.isqrt(int((v * v).sum()))
        kept.append(np.array([(int(e) << 256) // length for e in v], object))
    out = np.array([[float(Fraction(int(e), 1 << 256)) for e in v] for v in kept])
    # Either sign would do; the largest entry is positive.
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(axis=1)])[:, None]


def fit(rows: DataFrame, d: int, most: int = 32) -> Whitening:
    """The ``most`` largest components of the covariance of ``rows`` as :func:`vectors` gives them; components without variance are left out."""
    spark = rows.sparkSession
    total = scatter(rows, d)
    n, sums = total[d][d], tuple(total[d][:d])
    m = [[n * total[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    unit = math.gcd(*(x for row in m for x in row))
    m = [[x // unit for x in row] for row in m]
    trace //= unit
    whole = characteristic(spark, m)
    zeros = next(k for k, x in enumerate(reversed(whole)) if x)
    whole = whole[: len(whole) - zeros]
    f = simple_roots(whole)
    # One more than asked for tells the last one's distance.
    roots = parted(f, isolate(f, trace, most + 1), Fraction(0) if zeros and len(f) - 1 <= most else None)
    asked, seen = [], 0
    for r, gap in roots:
        if seen >= most:
            break
        times = roots_above(whole, r.lo, r.bits) - roots_above(whole, r.lo + 1, r.bits)
        asked.append((seen, times, r.rank, str(r.lo), r.bits, str(gap.numerator), str(gap.denominator)))
        seen += times

    def run(batches):
        for batch in batches:
            out = []
            for first, times, rank, lo, bits, num, den in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root, gap = Root(rank, int(lo), bits), Fraction(int(num), int(den))
                while root.low() <= 0:
                    root = root.halved(f)
                fine = max(root.bits, GUARD_BITS - math.floor(math.log2(min(gap, root.low()))))
                root = root.until(f, fine)
                basis = null_space(m, root.high() + Fraction(1, 1 << max(fine, 0)), max(fine, 0), times)
                out += [(first + k, v.tolist(), float(root.high() * unit / (n * n)), float(root.high() / trace)) for k, v in enumerate(basis)]
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["k", "v", "e", "share"])

    columns = "seen int, times int, rank int, lo string, bits int, num string, den string"
    table = spark.createDataFrame(asked, columns).repartition(min(len(asked), spark.sparkContext.defaultParallelism))
    found = sorted(table.mapInArrow(run, "k int, v array<double>, e double, share double").collect())[:most]
    return Whitening(n, sums, np.array([r["v"] for r in found]), np.array([r["e"] for r in found]), np.array([r["share"] for r in found]))


def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly."""
    if model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.sums)) < HELD:
        return model.n * y - np.array(model.sums, np.int64)
    return model.n * y.astype(object) - np.array(model.sums, object)


def _projected(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return (centred / model.n).astype(np.float64) @ (model.components / np.sqrt(model.variances)[:, None]).T


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null beyond a long."""
    if centred.dtype == object or int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] >= 1 << 63:
        sums = [sum(int(x) ** 2 for x in row) for row in centred]
        return [s if s < 1 << 63 else None for s in sums]
    return (centred * centred).sum(axis=1).tolist()


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all ``rows``."""
    k = len(model.variances)

    def run(batches):
        total = np.zeros((k, k + 1))
        for batch in batches:
            z = _projected(_centred(entries(batch.column(0), d), model), model)
            total[:, :k] += z.T @ z
            total[:, k] += z.sum(axis=0)
        i, j = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    total = np.zeros((k, k + 1))
    for r in rows.select("vec").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r["i"], r["j"]] = r["value"]
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, d: int, model: Whitening, error: float) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component, which count from 1."""
    k = len(model.variances)
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType(
        [T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    if not k:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            y = entries(batch.column(1), d)
            centred, size = _centred(y, model), len(y)
            each = np.repeat(np.arange(size), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, model.n)),
                pa.array(_deviations(centred), pa.int64()).take(pa.array(each)),
                pa.array(_projected(centred, model).ravel()),
                pa.array(np.tile(model.explained, size)),
                pa.array(np.full(size * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32) -> DataFrame:
    """Every vector's coordinates on the ``most`` largest components of all vectors, over the root of their variance.

    Columns as of :func:`whitened`. Rows without a usable vector are left out
    (:func:`vectors`); null ids and repeated rows stay and count. Entries are
    floor(64 c) + 1,000,000, where floor(64 c) is held within 2^62 on either
    side; a ``deviation`` beyond a long is null. Components without variance are
    left out, so equal vectors, a single one or an empty table give no rows.
    Equal eigenvalues share an eigenspace, of which any orthonormal basis is
    given, the same for all rows. Other columns don't matter.
    """
    rows, d = vectors(df, id_col, vec_col)
    if not d:
        return whitened(rows, 0, Whitening(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0)), 0.0)
    model = fit(rows, d, most)
    return whitened(rows, d, model, identity_error(rows, d, model))
