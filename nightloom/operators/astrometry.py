"""Plate solving against a catalogue table: geometric hashing of star quads, votes on the pose, tangent-plane fit.

A quad is a star with three of its nearest neighbours. Its two most distant stars span a frame of
reference, in which the other two have four coordinates: a code that doesn't change with place, turn and
scale. The catalogue's quads are an inverted index by rounded code; a frame's quads (and their mirror
images) probe it with an equi-join. Each match proposes a pose of the frame; the pose with the most votes
gives pairs of stars, these a first fit, and the stars that the first fit finds in the catalogue the final one.

Positions on the sky are joined by cells of the unit sphere's cube, so poles and the turn of right ascension need no care.
Tables: catalogue (star_id, ra, dec, mag), stars (frame_id, star, x, y, flux), frames (frame_id, width, height); degrees, pixels from 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .registration import TRANSFORMS
from .settle import settled

#: Neighbours of a star from which quads are made, and rounding and tolerance of a code.
NEAREST, CODE_STEP, CODE_OFF = 6, 0.04, 0.01
#: Numbers of brightest stars of a frame from which quads are made.
DEPTHS = (16, 32, 64)
#: Quads of an index that may be broadcast.
INDEX_ROWS = 200_000
#: Votes that a pose needs, and how many times as many tell that deeper stars needn't be looked at.
VOTES, SURE = 4, 2
#: Stars in a square as wide as the first distance at which the nearest one is looked for.
FIRST_FOUND = 0.03
SOLUTION = (
    "frame_id string, ra double, dec double, scale double, rotation double, flipped boolean, cd11 double, cd12 double, cd21 double, cd22 double, "
    "xi array<double>, eta array<double>, pairs int, rms double"
)


# ---- the sphere -------------------------------------------------------------------------------------
def unit_vector(ra: Column, dec: Column) -> list[Column]:
    ra, dec = F.radians(ra), F.radians(dec)
    return [F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)]


def tangent_plane(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """(xi, eta) in degrees of a position in the plane that touches the sphere at (ra0, dec0)."""
    a, d, d0 = F.radians(ra) - F.radians(ra0), F.radians(dec), F.radians(dec0)
    den = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    return F.degrees(F.cos(d) * F.sin(a) / den), F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)) / den)


def from_plane(xi: Column, eta: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """(ra, dec) of a place in the tangent plane."""
    xi, eta, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    den = F.cos(d0) - eta * F.sin(d0)
    ra = F.pmod(ra0 + F.degrees(F.atan2(xi, den)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + den * den)))


def _cells(v: Sequence[Column], side: float) -> Column:
    """The cell of a unit vector."""
    return F.struct(*[F.floor(x / side).alias(n) for x, n in zip(v, "xyz")])


def near_cells(v: Sequence[Column], side: float, reach: float) -> Column:
    """Hashes of the cells that hold all within `reach` of a unit vector: eight at most, one mostly if the cells are much wider."""
    ends = [(F.floor((x - reach) / side), F.floor((x + reach) / side)) for x in v]
    return F.array_distinct(F.array(*[F.xxhash64(*cell) for cell in product(*ends)]))


def sky_neighbours(left: DataFrame, right: DataFrame, degrees: float, wide: float = 1.0) -> DataFrame:
    """Rows of left and right (both with ra, dec; other names distinct) at most `degrees` apart, or a ten-thousandth more, with their unit vectors (x_a_ .. z_b_).

    An equi-join by hashes of cells `wide` times as wide as twice the distance: the wider, the fewer copies of left and the more
    candidates. right's position is right_ra, right_dec. Pairs are told apart by their chord, without any function of angles.
    """
    reach = 2 * math.sin(math.radians(degrees) / 2) * 1.0001
    side = 2 * reach * wide
    a, b = left, right.withColumnsRenamed({"ra": "right_ra", "dec": "right_dec"})
    a = a.withColumns({f"{n}_a_": c for n, c in zip("xyz", unit_vector(F.col("ra"), F.col("dec")))})
    b = b.withColumns({f"{n}_b_": c for n, c in zip("xyz", unit_vector(F.col("right_ra"), F.col("right_dec")))})
    a = a.withColumn("cell_", F.explode(near_cells([F.col(f"{n}_a_") for n in "xyz"], side, reach)))
    b = b.withColumn("cell_", F.xxhash64(*[F.floor(F.col(f"{n}_b_") / side) for n in "xyz"]))
    chord = sum(((F.col(f"{n}_a_") - F.col(f"{n}_b_")) * (F.col(f"{n}_a_") - F.col(f"{n}_b_")) for n in "xyz"), F.lit(0.0))
    return a.join(b, "cell_").where(chord <= reach * reach).drop("cell_")


def sky_pairs(left: DataFrame, right: DataFrame, degrees: float, wide: float = 1.0) -> DataFrame:
    """sky_neighbours with their distance as `apart` in degrees, and none beyond."""
    apart = great_circle(F.col("ra"), F.col("dec"), F.col("right_ra"), F.col("right_dec"))
    met = sky_neighbours(left, right, degrees, wide).drop(*[f"{n}_{side}_" for n in "xyz" for side in "ab"])
    return met.withColumn("apart", apart).where(F.col("apart") <= degrees)


def great_circle(ra: Column, dec: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two positions."""
    d1, d2 = F.radians(dec), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin((F.radians(ra2) - F.radians(ra)) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.sqrt(h), F.lit(1.0))))


# ---- quads ------------------------------------------------------------------------------------------
#: Which of a list's places make a quad: the star itself with three of its neighbours.
PLACES = np.array([(0, *c) for c in combinations(range(1, NEAREST + 1), 3)])


def codes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, code) of quads of complex points (n, 4): the points A, B, C, D as places 0 .. 3, and C's and D's coordinates where A is 0, 0 and B is 1, 1.

    A and B are the two most distant ones; C has the smaller x, and C and D together lie on A's side of the middle.
    """
    pairs = np.array(list(combinations(range(4), 2)))
    rest = np.array([[k for k in range(4) if k not in p] for p in pairs])
    widest = np.abs(z[:, pairs[:, 0]] - z[:, pairs[:, 1]]).argmax(axis=1)
    ab, cd = pairs[widest], rest[widest]
    a, b = (np.take_along_axis(z, ab[:, k : k + 1], axis=1) for k in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (np.take_along_axis(z, cd, axis=1) - a) / (b - a) * (1 + 1j)
    far = w.real.sum(axis=1) > 1
    w[far], ab[far] = (1 + 1j) - w[far], ab[far][:, ::-1]
    swap = (w[:, 0].real > w[:, 1].real) | ((w[:, 0].real == w[:, 1].real) & (w[:, 0].imag > w[:, 1].imag))
    w[swap], cd[swap] = w[swap][:, ::-1], cd[swap][:, ::-1]
    return np.concatenate([ab, cd], axis=1), np.stack([w[:, 0].real, w[:, 0].imag, w[:, 1].real, w[:, 1].imag], axis=1)


def quads(lists: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., ids, code) of neighbour lists (p: array of struct(id, u, v), the star itself first): each star with three of the others."""
    kind = lists.schema["p"].dataType.elementType["id"].dataType
    schema = StructType([*[lists.schema[k] for k in keep], StructField("ids", ArrayType(kind)), StructField("code", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(len(keep))
            flat, at = p.flatten(), p.offsets.to_numpy() - p.offsets[0].as_py()
            size = np.diff(at)
            z = flat.field("u").to_numpy(zero_copy_only=False) + 1j * flat.field("v").to_numpy(zero_copy_only=False)
            row, which = np.nonzero(PLACES.max(axis=1)[None, :] < size[:, None])
            at = at[row][:, None] + PLACES[which]
            order, code = codes(z[at]) if len(row) else (np.zeros((0, 4), dtype=int), np.zeros((0, 4)))
            good = np.isfinite(code).all(axis=1)
            ids = flat.field("id").take(pa.array(np.take_along_axis(at, order, axis=1)[good].ravel()))
            four = pa.array(np.arange(0, 4 * good.sum() + 1, 4, dtype=np.int32))
            kept = [batch.column(k).take(pa.array(row[good])) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(four, ids), pa.ListArray.from_arrays(four, pa.array(code[good].ravel()))], names=[*keep, "ids", "code"])

    return lists.where(F.size("p") >= 4).select(*keep, "p").mapInArrow(run, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """rows by frame_id over a number of tasks said outright: Spark would make few rows one task, but those of a frame are long work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_id")


def brightest(catalogue: DataFrame, cell: float, per_cell: int) -> DataFrame:
    """The brightest `per_cell` stars of each cell of about `cell` degrees: an even cover of the sky, whatever the catalogue's depth."""
    v = unit_vector(F.col("ra"), F.col("dec"))
    placed = catalogue.withColumn("cell_", _cells(v, math.radians(cell)))
    order = W.partitionBy("cell_").orderBy(F.asc_nulls_last("mag"), "star_id")
    return placed.withColumn("nth_", F.row_number().over(order)).where(F.col("nth_") <= per_cell).drop("cell_", "nth_")


def index_quads(catalogue: DataFrame, levels: Sequence[tuple[float, int]]) -> DataFrame:
    """The inverted index (ids, code, cell) of a catalogue's quads; levels: (cell in degrees, stars in it), one for each depth.

    A level's neighbours lie within two cells; a cell holds a bounded number of stars, so no neighbour list grows with the catalogue.
    """
    found = None
    for cell, per_cell in levels:
        stars = brightest(catalogue.select("star_id", "ra", "dec", "mag"), cell, per_cell).select("star_id", "ra", "dec")
        near = sky_pairs(stars, stars.select(F.col("star_id").alias("near_id"), "ra", "dec"), 2 * cell).where("near_id <> star_id")
        u, v = tangent_plane(F.col("right_ra"), F.col("right_dec"), F.col("ra"), F.col("dec"))
        own = F.struct(F.col("star_id").alias("id"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
        listed = near.select("star_id", F.struct("apart", F.col("near_id").alias("id"), u.alias("u"), v.alias("v")).alias("n")).groupBy("star_id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, NEAREST).alias("n"))
        level = quads(listed.select("star_id", F.concat(F.array(own), F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["u"].alias("u"), x["v"].alias("v")))).alias("p")), [])
        found = level if found is None else found.unionAll(level)
    return found.withColumn("cell", F.transform("code", lambda x: F.floor(x / CODE_STEP)))


def frame_quads(stars: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """(frame_id, flip, ids, code): quads of each frame's brightest stars and of its mirror image (flip -1)."""
    most = max(depths)
    order = W.partitionBy("frame_id").orderBy(F.desc_nulls_last("flux"), "star")
    top = dealt(stars).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    lists = top.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("star").alias("id"), F.col("x").alias("u"), F.col("y").alias("v")))).alias("s"))
    schema = StructType([lists.schema["frame_id"], StructField("flip", IntegerType()), StructField("ids", ArrayType(stars.schema["star"].dataType)), StructField("code", ArrayType(DoubleType()))])
    return lists.mapInArrow(_quads_of_frames(tuple(depths)), schema)


def _neighbours(z: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of a frame's stars itself and its nearest others as places of z, ties by rank; -1 where it has too few. Rows of one rank are one star."""
    off = np.square(z.real[None, :] - z.real[:, None]) + np.square(z.imag[None, :] - z.imag[:, None])
    off[rank[:, None] == rank[None, :]] = np.inf
    np.fill_diagonal(off, -1.0)
    near = np.lexsort((np.broadcast_to(rank, off.shape), off), axis=1)[:, : NEAREST + 1]
    return np.where(np.isposinf(np.take_along_axis(off, near, axis=1)), -1, near)


def _quads_of_frames(depths: tuple[int, ...]):
    """Lists (frame_id, s: a frame's brightest stars in order) to its distinct quads and those of its mirror image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(1)
            flat, ends = s.flatten(), s.offsets.to_numpy() - s.offsets[0].as_py()
            z = flat.field("u").to_numpy(zero_copy_only=False) + 1j * flat.field("v").to_numpy(zero_copy_only=False)
            by_id = pc.rank(flat.field("id"), tiebreaker="dense").to_numpy()
            rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 4), dtype=np.int64)]
            for r, (i, j) in enumerate(zip(ends, ends[1:])):
                own = []
                for n in sorted({min(d, j - i) for d in depths}):
                    near = _neighbours(z[i : i + n], by_id[i : i + n])
                    which = PLACES[PLACES.max(axis=1) < near.shape[1]]
                    four = near[:, which].reshape(-1, 4)
                    own.append(four[(four >= 0).all(axis=1)])
                four = np.unique(np.concatenate(own), axis=0) + i  # a star with the same neighbours at two depths has one quad
                rows.append(np.full(len(four), r))
                places.append(four)
            rows, places = np.concatenate(rows), np.concatenate(places)
            for flip in (1, -1):
                order, code = codes(z[places] if flip == 1 else z[places].conj()) if len(rows) else (np.zeros((0, 4), dtype=int), np.zeros((0, 4)))
                at, good = np.take_along_axis(places, order, axis=1), np.isfinite(code).all(axis=1)
                good[good] = _first_of_equal(rows[good], at[good])
                for k in range(0, len(rows), 1 << 16):
                    part = np.flatnonzero(good[k : k + (1 << 16)]) + k
                    four = pa.array(np.arange(0, 4 * len(part) + 1, 4, dtype=np.int32))
                    ids = pa.ListArray.from_arrays(four, flat.field("id").take(pa.array(at[part].ravel())))
                    code_ = pa.ListArray.from_arrays(four, pa.array(code[part].ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[part])), pa.array(np.full(len(part), flip, dtype=np.int32)), ids, code_], names=["frame_id", "flip", "ids", "code"])

    return run


def _first_of_equal(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Marks one of the quads with the same four stars in the same roles."""
    out = np.zeros(len(rows), dtype=bool)
    out[np.unique(np.column_stack([rows, places]), axis=0, return_index=True)[1]] = True
    return out


def matches(frames: DataFrame, index: DataFrame, off: float = CODE_OFF) -> DataFrame:
    """(frame_id, flip, ids, sky): quads whose codes differ by `off` at most in each coordinate.

    Each quad of the index, of which there are fewer, is put into its cell, and the next where the code is near its border; a
    frame's quads probe one cell each.
    """
    sky = index.select(F.col("ids").alias("sky"), F.col("code").alias("sky_code"))
    for k in range(4):
        c = F.col("sky_code")[k]
        sky = sky.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(F.floor((c - off) / CODE_STEP), F.floor((c + off) / CODE_STEP)))))
    sky = sky.select("sky", "sky_code", "c0", "c1", "c2", "c3")
    probes = frames.select("frame_id", "flip", "ids", "code", *[F.floor(F.col("code")[k] / CODE_STEP).alias(f"c{k}") for k in range(4)])
    close = [F.abs(F.col("code")[k] - F.col("sky_code")[k]) <= off for k in range(4)]
    return probes.join(sky, [f"c{k}" for k in range(4)]).where(close[0] & close[1] & close[2] & close[3]).select("frame_id", "flip", "ids", "sky")


# ---- poses ------------------------------------------------------------------------------------------
def proposals(found: DataFrame, stars: DataFrame, catalogue: DataFrame, frames: DataFrame) -> DataFrame:
    """found with the pose that its two most distant stars give: ra, dec of the frame's centre and scale in degrees a pixel."""
    at = lambda name, k: stars.select("frame_id", F.col("star").alias(f"id_{name}"), F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))
    sky = lambda name: catalogue.select(F.col("star_id").alias(f"sky_{name}"), F.col("ra").alias(f"ra_{name}"), F.col("dec").alias(f"dec_{name}"))
    rows = found.withColumns({"id_a": F.col("ids")[0], "id_b": F.col("ids")[1], "sky_a": F.col("sky")[0], "sky_b": F.col("sky")[1]})
    rows = rows.join(at("a", 0), ["frame_id", "id_a"]).join(at("b", 1), ["frame_id", "id_b"]).join(sky("a"), "sky_a").join(sky("b"), "sky_b").join(frames.select("frame_id", "width", "height"), "frame_id")
    xi, eta = tangent_plane(F.col("ra_b"), F.col("dec_b"), F.col("ra_a"), F.col("dec_a"))
    rows = rows.withColumns({"xi": xi, "eta": eta, "dx": F.col("x_b") - F.col("x_a"), "dy": (F.col("y_b") - F.col("y_a")) * F.col("flip")})
    d = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    rows = rows.where(d > 0).withColumns({"za": (F.col("xi") * F.col("dx") + F.col("eta") * F.col("dy")) / d, "zb": (F.col("eta") * F.col("dx") - F.col("xi") * F.col("dy")) / d})
    rows = rows.withColumns({"wx": (F.col("width") - 1) / 2 - F.col("x_a"), "wy": ((F.col("height") - 1) / 2 - F.col("y_a")) * F.col("flip")})
    cx, cy = F.col("za") * F.col("wx") - F.col("zb") * F.col("wy"), F.col("za") * F.col("wy") + F.col("zb") * F.col("wx")
    ra, dec = from_plane(cx, cy, F.col("ra_a"), F.col("dec_a"))
    return rows.select("frame_id", "flip", "ids", "sky", F.greatest("width", "height").alias("pixels"), ra.alias("ra"), dec.alias("dec"), F.sqrt(F.col("za") ** 2 + F.col("zb") ** 2).alias("scale")).where("scale > 0")


def votes(proposed: DataFrame, least: int = VOTES) -> DataFrame:
    """The proposals of each frame's best pose. A pose's cell is a quarter octave of scale and a tenth of the frame on the sky.

    Each proposal votes in 16 grids, staggered by half a cell in each of the four coordinates, so two close
    poses share a cell in one of them. The 16 copies are counted, but not kept: a proposal is put into the best pose's grid again.
    """
    half = F.explode(F.array(F.lit(0.0), F.lit(0.5)))
    step = F.floor(F.log2("scale") * 4 + F.col("gs"))
    side = F.radians(F.pow(F.lit(2.0), F.col("s") / 4) * F.col("pixels")) * 0.1
    at = {n: F.floor(v / side + F.col(f"g{n}")) for n, v in zip("xyz", unit_vector(F.col("ra"), F.col("dec")))}
    own = dealt(proposed)
    rows = own.withColumn("gs", half).withColumn("s", step)
    for n, place in at.items():
        rows = rows.withColumn(f"g{n}", half).withColumn(f"b{n}", place)
    key = ["flip", "gs", "s", "gx", "bx", "gy", "by", "gz", "bz"]
    counts = rows.groupBy("frame_id", *key).agg(F.count_distinct("ids").alias("n")).where(F.col("n") >= least)
    best = counts.groupBy("frame_id").agg(F.max(F.struct("n", *key)).alias("b")).select("frame_id", "b.*").withColumnRenamed("flip", "flip_")
    met = own.join(best.hint("merge"), "frame_id").where((F.col("flip") == F.col("flip_")) & (step == F.col("s")))  # both lie by frame_id
    for n, place in at.items():
        met = met.where(place == F.col(f"b{n}"))
    return met.select("frame_id", "flip", "ids", "sky", "n")


def _terms(u: np.ndarray, v: np.ndarray, order: int) -> np.ndarray:
    return np.stack([u**i * v ** (d - i) for d in range(order + 1) for i in range(d, -1, -1)], axis=1)


def _fit_frames(order: int, tolerance: float):
    """Lists (frame_id, width, height, p: a frame's pairs of stars) to solutions."""

    def plane(ra, dec, ra0, dec0):
        a, d, d0 = np.radians(ra - ra0), np.radians(dec), np.radians(dec0)
        den = np.sin(d) * np.sin(d0) + np.cos(d) * np.cos(d0) * np.cos(a)
        return np.degrees(np.cos(d) * np.sin(a) / den), np.degrees((np.sin(d) * np.cos(d0) - np.cos(d) * np.sin(d0) * np.cos(a)) / den)

    def fit(u, v, ra, dec) -> tuple | None:
        """Terms of u, v (pixels from the centre): constant, u, v, u2, uv, v2, ...; stars far off the fit are left out, one quarter of the rest kept at least."""
        near = np.ones(len(u), dtype=bool)
        w = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))]).mean(axis=1)
        ra0, dec0 = math.degrees(math.atan2(w[1], w[0])), math.degrees(math.atan2(w[2], math.hypot(w[0], w[1])))
        for _ in range(30):
            used = order if near.sum() >= (order + 1) * (order + 2) else 1
            if near.sum() < 3:
                return None
            terms = _terms(u, v, used)
            xi, eta = plane(ra, dec, ra0, dec0)
            a, b = np.linalg.lstsq(terms[near], np.stack([xi[near], eta[near]], axis=1), rcond=None)[0].T
            off = np.hypot(terms @ a - xi, terms @ b - eta)
            scale = math.sqrt(abs(a[1] * b[2] - a[2] * b[1]))
            # the point under the centre becomes the point of contact
            x, y, d0 = math.radians(a[0]), math.radians(b[0]), math.radians(dec0)
            den = math.cos(d0) - y * math.sin(d0)
            ra0, dec0 = (ra0 + math.degrees(math.atan2(x, den))) % 360, math.degrees(math.atan2(math.sin(d0) + y * math.cos(d0), math.hypot(x, den)))
            limit = max(tolerance * scale, 3 * np.median(off[near]))
            now = off <= limit
            if now.sum() < max(3, len(u) // 4):
                now = near
            if (now == near).all() and math.hypot(a[0], b[0]) < 1e-11:
                break
            near = now
        rms = float(np.sqrt((off[near] ** 2).mean())) * 3600
        turn, flipped = math.degrees(math.atan2(a[2], b[2])), bool(a[1] * b[2] - a[2] * b[1] > 0)
        return ra0, dec0, scale * 3600, turn, flipped, a[1], a[2], b[1], b[2], a.tolist(), b.tolist(), int(near.sum()), rms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SOLUTION.split(", ")]
        kinds = [pa.float64()] * 4 + [pa.bool_()] + [pa.float64()] * 4 + [pa.list_(pa.float64())] * 2 + [pa.int32(), pa.float64()]
        for batch in batches:
            p = batch.column(3)
            flat, ends = p.flatten(), p.offsets.to_numpy() - p.offsets[0].as_py()
            x, y, ra, dec, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "ra", "dec", "n"))
            star, sky = (pc.rank(flat.field(c), tiebreaker="dense").to_numpy() for c in ("star", "star_id"))
            best = np.lexsort((sky, star, -n, np.repeat(np.arange(len(p)), np.diff(ends))))
            width, height = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            rows, found = [], []
            for r, (i, j) in enumerate(zip(ends, ends[1:])):
                at = best[i:j]
                for of in (star, sky):  # the first of each star, then of each star of the sky
                    at = at[np.sort(np.unique(of[at], return_index=True)[1])]
                solution = fit(x[at] - (width[r] - 1) / 2, y[at] - (height[r] - 1) / 2, ra[at], dec[at])
                if solution is not None:
                    rows.append(r)
                    found.append(solution)
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)

    return run


def fitted(pairs: DataFrame, order: int = 1, tolerance: float = 2.0) -> DataFrame:
    """Solutions from (frame_id, star, x, y, star_id, ra, dec, n, width, height): a row's list is one frame's bounded list."""
    listed = dealt(pairs).groupBy("frame_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.collect_list(F.struct("star", "x", "y", "star_id", "ra", "dec", "n")).alias("p"))
    return listed.mapInArrow(_fit_frames(order, tolerance), SOLUTION)


def to_sky(stars: DataFrame, solutions: DataFrame, frames: DataFrame) -> DataFrame:
    """stars with ra, dec by their frame's solution, its polynomial included; stars of unsolved frames are left out."""
    s = stars.join(solutions.select("frame_id", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), "xi", "eta"), "frame_id").join(frames.select("frame_id", "width", "height"), "frame_id")
    s = s.withColumns({"u_": F.col("x") - (F.col("width") - 1) / 2, "v_": F.col("y") - (F.col("height") - 1) / 2})
    powers = [(i, d - i) for d in range(6) for i in range(d, -1, -1)]

    def value(c: str) -> Column:
        return sum((F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) * (F.pow("u_", i) * F.pow("v_", j)) for k, (i, j) in enumerate(powers)), F.lit(0.0))

    ra, dec = from_plane(value("xi"), value("eta"), F.col("ra0"), F.col("dec0"))
    return s.withColumns({"ra": ra, "dec": dec}).drop("ra0", "dec0", "xi", "eta", "u_", "v_")


def solve(
    stars: DataFrame, frames: DataFrame, catalogue: DataFrame, levels: Sequence[tuple[float, int]], order: int = 1, least_votes: int = VOTES, tolerance: float = 2.0,
    hints: DataFrame | None = None, scale: tuple[float, float] | None = None, depths: Sequence[int] = DEPTHS, most: int = 200,
) -> DataFrame:
    """Per solved frame: ra, dec of its centre, scale (arcseconds a pixel), rotation (of the frame's y axis from north through east), flipped, CD matrix, polynomials, pairs, rms (arcseconds).

    levels: depths of the catalogue's index, cells of about a quarter of a frame. order: of the polynomials, 1 to 5; frames with
    too few pairs take 1. hints: (frame_id, ra, dec, radius) in degrees, of frames whose pose must lie there. scale: least and largest
    arcseconds a pixel, of a known focal length and pixel size. The `most` brightest stars of a frame take part in the final fit.
    A frame's quads are made of its brightest stars at the first depth; only frames of which no pose has SURE times the votes it
    needs go on to those of the first two depths, and so on. Frames without enough agreeing quads have no row. Nulls in positions make a star unusable.
    """
    stars = settled(stars.where("x is not null and y is not null").select("frame_id", "star", "x", "y", "flux"))  # read five times
    catalogue = catalogue.where("ra is not null and dec is not null").select("star_id", "ra", "dec", "mag")
    index = settled(index_quads(catalogue, levels).drop("cell"))
    few = (lambda df: F.broadcast(df)) if index.count() <= INDEX_ROWS else (lambda df: df)
    anchors = few(settled(catalogue.drop("mag").join(few(index.select(F.explode("ids").alias("star_id")).distinct()), "star_id", "left_semi")))  # proposals need no other stars of the sky

    def voted(of: DataFrame, depths: Sequence[int], least: int) -> DataFrame:
        posed = proposals(matches(frame_quads(of, depths), few(index)), of, anchors, frames)
        if scale is not None:
            posed = posed.where((F.col("scale") * 3600).between(*scale))
        if hints is not None:
            h = hints.select("frame_id", F.col("ra").alias("ra_h"), F.col("dec").alias("dec_h"), "radius")
            posed = posed.join(h, "frame_id", "left").where(F.col("radius").isNull() | (great_circle(F.col("ra"), F.col("dec"), F.col("ra_h"), F.col("dec_h")) <= F.col("radius"))).drop("ra_h", "dec_h", "radius")
        return votes(settled(posed), least)

    depths, left, chosen = sorted(depths), stars, None
    for k in range(1, len(depths) + 1):
        last = k == len(depths)
        found = voted(left, depths[:k], least_votes if last else SURE * least_votes)
        if not last:
            found = settled(found)
            left = settled(left.join(found.select("frame_id").distinct(), "frame_id", "left_anti"))
        chosen = found if chosen is None else chosen.unionAll(found)
        if not last and left.isEmpty():
            break
    pair = F.explode(F.zip_with("ids", "sky", lambda a, b: F.struct(a.alias("star"), b.alias("star_id"))))
    pairs = chosen.select("frame_id", pair.alias("p")).select("frame_id", "p.*").groupBy("frame_id", "star", "star_id").agg(F.count(F.lit(1)).alias("n"))
    sized = lambda p: p.join(stars.drop("flux"), ["frame_id", "star"]).join(frames.select("frame_id", "width", "height"), "frame_id")
    first = settled(fitted(sized(pairs.join(anchors, "star_id")), 1, tolerance))
    nth = F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc_nulls_last("flux"), "star"))
    top = stars.withColumn("nth", nth).where(F.col("nth") <= max(most, *depths))

    def again(by: DataFrame, count: int, sky: DataFrame) -> DataFrame:
        """Pairs of so many bright stars with the sky where a solution puts them, as far off as twice the tolerance."""
        reach = F.col("scale") * tolerance * 2 / 3600
        placed = settled(to_sky(top.where(F.col("nth") <= count).drop("nth", "flux"), by, frames).drop("width", "height").join(by.select("frame_id", reach.alias("reach"), F.col("scale").alias("scale_")), "frame_id"))
        return nearest_within_reach(placed, sky, ["frame_id", "star"]).select("frame_id", "star", "star_id", F.lit(1).alias("n"), F.col("right_ra").alias("ra"), F.col("right_dec").alias("dec"))

    # quads of few stars can leave a wrong pair in the fit: once more against the few stars of the index, among which the nearest is hardly ever a wrong one
    second = fitted(sized(again(first, max(depths), anchors)), 1, tolerance)
    better = first.withColumn("of_", F.lit(0)).unionByName(second.withColumn("of_", F.lit(1))).withColumn("all_", F.struct(*first.columns))
    first = settled(better.groupBy("frame_id").agg(F.max_by("all_", F.struct("pairs", "of_")).alias("s")).select("s.*"))
    # then all bright stars against the whole catalogue
    return fitted(sized(again(first, most, catalogue.drop("mag"))), order, tolerance)


def transforms_to(solutions: DataFrame, frames: DataFrame, reference: str) -> DataFrame:
    """Each solved frame's transform to the pixels of the solved reference frame, for registration.apply_transforms.

    Two tangent planes of one sphere are related by a homography: the frame's pixels to its plane, turned on the
    sphere, and from the reference's plane to its pixels. Polynomials beyond the linear terms are left out. Without a solved reference there are no rows.
    """
    rows = solutions.join(frames.select("frame_id", "width", "height"), "frame_id").select("frame_id", "ra", "dec", "cd11", "cd12", "cd21", "cd22", "width", "height", "pairs")
    ref = rows.where(F.col("frame_id") == reference).select(*[F.col(c).alias(f"r_{c}") for c in ("ra", "dec", "cd11", "cd12", "cd21", "cd22", "width", "height")])

    def to_sphere(ra, dec, cd, width, height):
        """Pixel (x, y, 1) to a vector of the sphere, up to its length."""
        a, d = math.radians(ra), math.radians(dec)
        east, north, up = (-math.sin(a), math.cos(a), 0), (-math.sin(d) * math.cos(a), -math.sin(d) * math.sin(a), math.cos(d)), (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))
        plane = np.radians(np.array([[cd[0], cd[1], 0], [cd[2], cd[3], 0], [0, 0, 0]])) + np.array([[0, 0, 0], [0, 0, 0], [0, 0, 1]])
        centre = np.array([[1, 0, -(width - 1) / 2], [0, 1, -(height - 1) / 2], [0, 0, 1]])
        return np.array([east, north, up]).T @ plane @ centre

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                own = to_sphere(r.ra, r.dec, (r.cd11, r.cd12, r.cd21, r.cd22), r.width, r.height)
                m = np.linalg.inv(to_sphere(r.r_ra, r.r_dec, (r.r_cd11, r.r_cd12, r.r_cd21, r.r_cd22), r.r_width, r.r_height)) @ own
                m /= m[2, 2]
                out.append((r.frame_id, *m[0], *m[1], m[2, 0], m[2, 1], int(r.pairs)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSFORMS.split(", ")])

    return rows.crossJoin(F.broadcast(ref)).mapInPandas(run, TRANSFORMS)  # one row of the reference


def nearest_within_reach(placed: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nearest catalogue star (ties: the smallest star_id) of each row of placed (keys, ra, dec, reach in degrees) that has one within its own reach.

    Cells come in powers of two of a degree, and a row's reach lies under its own power. The search begins so close that in
    the catalogue's mean density one row in ten meets a star by chance, in cells of about two stars; only rows without a star
    there look further, four times as far, up to their reach. So candidates don't grow with the density.
    """
    nearest = F.row_number().over(W.partitionBy(*keys).orderBy("apart", "star_id"))
    first = lambda met: met.withColumn("nth_", nearest).where("nth_ = 1").drop("nth_")
    placed = placed.withColumn("power_", F.ceil(F.log2(F.col("reach"))).cast("int"))
    used = [r[0] for r in placed.select("power_").distinct().orderBy("power_").collect()]  # a few dozen at most: powers of two of a degree
    out = None
    for p in used:
        widest = min(2.0**p, 60.0)
        side = 2 * math.sin(math.radians(widest) / 2)
        n, cells = catalogue.select(_cells(unit_vector(F.col("ra"), F.col("dec")), side).alias("c")).agg(F.count(F.lit(1)), F.approx_count_distinct("c")).first()
        halvings = max(0, math.ceil(math.log2(max(1, n) / max(1, cells) / FIRST_FOUND) / 2))
        todo = placed.where(F.col("power_") == p)
        for k in [*range(halvings, 0, -2), 0]:
            met = first(sky_pairs(todo, catalogue, widest / 2**k, wide=4.0 if k and k == halvings else 1.0).where("apart <= reach"))
            if k:
                met = settled(met)
                todo = settled(todo.join(met.select(*keys), keys, "left_anti"))
            out = met if out is None else out.unionAll(met)
            if k and todo.isEmpty():
                break
    if out is None:
        out = first(sky_pairs(placed, catalogue, 1.0).where("apart <= reach"))
    return out.drop("power_", "reach")
