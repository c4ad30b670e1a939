"""Every registered query with SQL against DuckDB on the small tables: names, types, values."""

import math
from statistics import NormalDist

import duckdb
import numpy as np
import pytest

from nightloom.operators import frequency
from nightloom.plans import catalogue, imaging, observatory  # noqa: F401  these add their queries to the catalogue's

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert columns == sorted(names)
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want
    assert {c: TYPES[t] for c, t in df.dtypes} == {c[0]: str(c[1]) for c in cur.description}


# ---- queries that SQL doesn't express, by NumPy on the same frames ----------------------------------
def frames():
    rows = duckdb.sql(f"select vec_id, label, embedding from '{DATA}/embeddings.parquet' order by vec_id").fetchall()
    return {i: (label, np.array(e, dtype=np.float64).reshape(8, 8)) for i, label, e in rows}


def rotated(a, degrees):
    """Bilinear, border repeated, clamped to the frame's values; empty outside."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = {}
    for y in range(8):
        for x in range(8):
            dy, dx = y - 3.5, x - 3.5
            v, u = s * dx + c * dy + 3.5, c * dx - s * dy + 3.5
            if -0.5 < v < 7.5 and -0.5 < u < 7.5:
                j, i, total = math.floor(v), math.floor(u), 0.0
                for b in (0, 1):
                    for k in (0, 1):
                        total += (1 - abs(v - j - b)) * (1 - abs(u - i - k)) * a[min(max(j + b, 0), 7), min(max(i + k, 0), 7)]
                out[y, x] = min(max(total, a.min()), a.max())
    return out


def levelled(a):
    """A plane through the four by four samples up to median + 3 MAD, less its mean, taken off."""
    at = [(y, x) for y in range(1, 8, 2) for x in range(1, 8, 2)]
    med = np.median(a)
    mad = np.median([abs(a[p] - med) for p in at])
    at = [p for p in at if a[p] <= med + 3 * mad]
    k = np.linalg.lstsq(np.array([(1, y, x) for y, x in at], dtype=float), np.array([a[p] for p in at]), rcond=None)[0]
    y, x = np.mgrid[0:8, 0:8]
    plane = k[0] + k[1] * y + k[2] * x
    return a - plane + plane.mean()


def esd_mean(values, outliers=0.3, significance=0.05):
    v, z = sorted(values), NormalDist().inv_cdf(1 - significance / 2)
    for _ in range(max(1, math.floor(len(v) * outliers))):
        n = len(v)
        mean = sum(v) / n
        sd = math.sqrt(sum((x - mean) ** 2 for x in v) / max(n - 1, 1))
        if n > 3 and max(mean - v[0], v[-1] - mean) > z * (n - 1) / math.sqrt(n * (n - 2 + z * z)) * sd:
            v = v[1:] if mean - v[0] > v[-1] - mean else v[:-1]
    return sum(v) / len(v)


def lucy(a, psf, rounds):
    r = psf.shape[0] // 2

    def conv(b, k):
        pad = np.pad(b, r, mode="symmetric")
        return sum(k[i, j] * pad[i : i + 8, j : j + 8] for i in range(2 * r + 1) for j in range(2 * r + 1))

    now = a.copy()
    for _ in range(rounds):
        now = now * conv(a / np.maximum(conv(now, psf), 1e-12), psf[::-1, ::-1])
    return now


def wiener(a, psf, noise):
    r, k = psf.shape[0] // 2, np.zeros((8, 8))
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            k[i % 8, j % 8] += psf[i + r, j + r]
    h = np.fft.fft2(k)
    return np.fft.ifft2(np.fft.fft2(a) * h.conj() / (np.abs(h) ** 2 + noise)).real


BRUTE = {
    "rotate_angle": lambda a: rotated(a, 30.0), "background_poly": levelled,
    "deconvolve_lucy": lambda a: lucy(np.abs(a), frequency.gaussian_psf(1.5), 3), "deconvolve_wiener": lambda a: wiener(a, frequency.gaussian_psf(1.5), 0.05),
}


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_same_as_numpy(spark, name):
    got = {(r.vec_id, r.y, r.x): r.v for r in catalogue.QUERIES[name](spark, DATA).collect()}
    want = {}
    for i, (_, a) in frames().items():
        made = BRUTE[name](a)
        want |= {(i, y, x): v for (y, x), v in (made.items() if isinstance(made, dict) else np.ndenumerate(made))}
    assert got.keys() == want.keys() and max(abs(got[k] - v) for k, v in want.items()) < 2e-6


def test_esd_stack_same_as_numpy(spark):
    by = {}
    for label, a in frames().values():
        by.setdefault(label, []).append(a)
    got = {(r.label, r.y, r.x): r.v for r in catalogue.QUERIES["stack_esd"](spark, DATA).collect()}
    want = {(label, y, x): esd_mean([a[y, x] for a in many]) for label, many in by.items() for y in range(8) for x in range(8)}
    assert got.keys() == want.keys() and max(abs(got[k] - v) for k, v in want.items()) < 2e-6


def test_every_query_is_checked():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {*BRUTE, "stack_esd"}
