"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Trees are fitted on a bounded sample: each node has a random direction, the median projection of its
sample and a margin; vectors within the margin go down both sides. Every vector is then sent to its
leaves in all trees. Leaves that hold too many vectors are split further by Spark jobs, with a random
direction for each leaf and the median of all its vectors. Vectors of a leaf are compared in blocks
of bounded size, pairs are verified by their cosine in double precision, counted and united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import components, cut, drop, small

TREES = 8
#: Vectors of a leaf, about; a leaf beyond four times that is split further.
LEAF = 256
#: Distinct vectors the trees are fitted on, at most (all but for a chance of 1 in 30,000); those with a hash below a bound set by their number.
SAMPLE = 20_000
#: Share of a node's vectors that go down both sides, at least; also those nearer to the cut than half the distance of a link,
#: so that a group of near copies stays in one leaf.
SPILL = 0.12
#: Vectors of one block of a leaf.
BLOCK = 1024


class Node(NamedTuple):
    direction: np.ndarray
    median: float
    margin: float
    left: int
    right: int


def _prepare(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, prints = [], []
            for x in batch.column(1):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zeros
                    wide = v.astype(np.float64)
                    if not np.isfinite(wide).all() or not wide.any():
                        v = None
                vecs.append(None if v is None else v.tobytes())
                prints.append(None if v is None else hashlib.blake2b(vecs[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(prints, pa.binary())], names=["id", "vec", "print"])

    return run


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of one length, in double precision."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def grow(x: np.ndarray, leaf: float, spill: float, reach: float, seed: int) -> list[Node | None]:
    """One tree on a sample; None stands for a leaf. Vectors within half of `reach` of a cut go down both sides."""
    rng, nodes, todo = np.random.default_rng(seed), [None], [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        if len(own) <= max(leaf, 8):
            continue
        direction = rng.normal(size=x.shape[1])
        p = x[own] @ direction
        low, median, high = np.quantile(p, [0.5 - spill / 2, 0.5, 0.5 + spill / 2])
        margin = max((high - low) / 2, reach / 2)
        left, right = own[p <= median + margin], own[p >= median - margin]
        if max(len(left), len(right)) > 0.9 * len(own):  # many equal projections: no use to split
            continue
        nodes[at] = Node(direction, median, margin, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, left), (len(nodes) - 1, right)]
    return nodes


def leaves(x: np.ndarray, nodes: list[Node | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x that reach it)."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        node = nodes[at]
        if not len(own):
            continue
        if node is None:
            yield at, own
            continue
        p = x[own] @ node.direction
        todo += [(node.left, own[p <= node.median + node.margin]), (node.right, own[p >= node.median - node.margin])]


def _index(shared, kind: str):
    """Rows (leaf, id): one for each leaf a vector reaches. A leaf's key says tree, node and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1).to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                x = units([raw[r] for r in rows], kind)
                for tree, nodes in enumerate(forests.get(x.shape[1], [[None]])):
                    for at, own in leaves(x, nodes):
                        take = pa.array(rows[own])
                        key = np.full(len(own), ((x.shape[1] << 40) + (tree << 32) + at), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(take)], names=["leaf", "id"])

    return run


def _project(kind: str, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = batch.column(0).to_numpy(), batch.column(3).to_pylist()
            p = np.zeros(len(keys))
            for k in np.unique(keys):
                rows = np.flatnonzero(keys == k)
                x = units([raw[r] for r in rows], kind)
                p[rows] = x @ np.random.default_rng([salt, k & 0xFFFFFFFF, (k >> 32) & 0xFFFFFFFF]).normal(size=x.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["leaf", "id", "k", "p"])

    return run


def _refined(rows: DataFrame, vectors: DataFrame, kind: str, most: int, spill: float, reach: float, rounds: int = 40) -> DataFrame:
    """rows (leaf, id) with leaves of more than `most` vectors split, as long as that helps; both sides get what lies within half of `reach`."""
    done = []
    for turn in range(rounds):
        sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"))
        large = cut(sizes.where(F.col("k") > most))
        if not large.limit(1).count():
            break
        done.append(rows.join(small(large.select("leaf")), "leaf", "left_anti"))
        held = rows.join(small(large), "leaf").join(vectors.select("id", "vec"), "id").select("leaf", "id", "k", "vec")
        p = cut(held.mapInArrow(_project(kind, turn), "leaf long, id long, k long, p double"))
        cuts = p.groupBy("leaf").agg(F.percentile_approx("p", [0.5 - spill / 2, 0.5, 0.5 + spill / 2], 1000).alias("q"))
        low, high = F.least(F.col("q")[0], F.col("q")[1] - reach / 2), F.greatest(F.col("q")[2], F.col("q")[1] + reach / 2)
        sides = F.filter(F.array(F.when(F.col("p") <= high, 1), F.when(F.col("p") >= low, 2)), lambda s: s.isNotNull())
        sided = p.join(cuts, "leaf").select("leaf", "id", "k", F.explode(sides).alias("side"))
        split = sided.withColumn("part", F.xxhash64("leaf", "side", F.lit(turn)))
        parts = split.groupBy("leaf", "part").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
        stuck = parts.groupBy("leaf").agg(F.max(F.col("n") > 0.9 * F.col("k")).alias("s")).where("s").select("leaf")
        # leaves that don't shrink stay whole: their blocks are compared one by one
        done.append(p.join(stuck, "leaf", "left_semi").select("leaf", "id"))
        rows = cut(split.join(stuck, "leaf", "left_anti").select(F.col("part").alias("leaf"), "id"))
    for d in done:
        rows = rows.unionByName(d)
    return rows


def _counted_before(own: pa.ListArray, leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows (a, b) whether both are also in a leaf with a smaller key, which counts the pair."""
    n = len(own)
    row, at = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()
    paired = np.zeros(n, dtype=bool)
    paired[a] = paired[b] = True
    use = (at < leaf) & paired[row]
    row, at = row[use], at[use]
    _, col, seen = np.unique(at, return_inverse=True, return_counts=True)
    row, col = row[seen[col] > 1], col[seen[col] > 1]
    width = np.bincount(row, minlength=n)
    columns = np.full((n, max(1, width.max(initial=0))), len(seen))  # the last column of the table below is empty
    columns[row, np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)] = col
    member = np.zeros((n, len(seen) + 1), dtype=bool)
    member[row, col] = True
    before = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 18):
        x, y = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
        for w in range(columns.shape[1]):
            before[i : i + len(x)] |= member[y, columns[x, w]]
    return before


def _trees(near: np.ndarray) -> np.ndarray:
    """Per row the first row reachable from it over the symmetric relation near."""
    root = np.full(len(near), -1)
    for first in range(len(near)):
        todo = np.array([first]) if root[first] < 0 else np.array([], dtype=int)
        while len(todo):
            root[todo] = first
            todo = np.flatnonzero(near[todo].any(axis=0) & (root < 0))
    return root


def _compare(kind: str, least: float):
    """Rows (a, b, k) of a pair of blocks: k linked vectors of a that no other leaf counts (b is null), and
    edges (a, b) of a forest with the components of the links found (k is null)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, block, weight = (table.column(c).to_numpy() for c in ("id", "block", "n"))
        x = units(table.column("vec").to_pylist(), kind)
        one = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        near = np.zeros((len(x), len(x)), dtype=bool)
        for i in range(0, len(x), 512):
            cosine = x[i : i + 512] @ x.T
            near[i : i + 512] = cosine >= least
            a, b = np.nonzero(np.abs(cosine - least) < 1e-9)  # one way of adding up decides at the threshold
            for j in range(0, len(a), 1 << 16):
                p, q = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)]
                near[p, q] = (x[p] * x[q]).sum(axis=1) >= least
        near = np.triu(near, 1)  # ids rise and differ
        if not one:
            near &= block[:, None] != block
        a, b = np.nonzero(near)
        root = _trees(near | near.T)
        hung = np.flatnonzero(root != np.arange(len(x)))
        new = ~_counted_before(table.column("own").chunk(0), table.column("leaf")[0].as_py(), a, b)
        a, b = a[new], b[new]
        k = (np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))).astype(np.int64)
        some = np.flatnonzero(k)
        return pa.table(
            {
                "a": np.concatenate([ids[some], ids[root[hung]]]),
                "b": pa.chunked_array([pa.nulls(len(some), pa.int64()), pa.array(ids[hung])]),
                "k": pa.chunked_array([pa.array(k[some]), pa.nulls(len(hung), pa.int64())]),
            }
        )

    return run


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, spill: float = SPILL, block: int = BLOCK
) -> DataFrame:
    """Per row of df: (id_col, n_links, component_id, kept).

    Pairs found with cosine >= least link, none below. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, nor do those with a null id; so do vectors of different
    lengths with each other. Equal vectors are one class in the forest and count one by one in n_links,
    repeated rows too. Other columns are ignored, whatever their names.

    Through the trees go ids; vectors join them for the compare only. A pair that shares several leaves
    is counted in the one with the smallest key. What leaves a pair of blocks are counts and a forest of
    its links, so rows grow with the vectors of a group of near copies, not with its pairs.
    """
    kind = "f4" if df.schema[vec_col].dataType.elementType.typeName() == "float" else "f8"
    rows = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(_prepare(kind), "id long, vec binary, print binary"))
    classes = cut(rows.where("print is not null and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")))
    n_classes = classes.count()
    share = min(1.0, (sample - 4 * sample**0.5) / n_classes) if n_classes > sample else 1.0
    some = classes if share == 1 else classes.where(F.pmod(F.xxhash64("print"), F.lit(1 << 32)) < int(share * (1 << 32)))
    picked = [bytes(r["vec"]) for r in sorted(some.select("print", "vec").collect(), key=lambda r: bytes(r["print"]))]
    reach = (2 - 2 * least) ** 0.5  # distance of unit vectors at the threshold, and what their projections differ by at one standard deviation
    fitted: dict[int, list] = {}
    for size in {len(v) for v in picked}:
        x = units([v for v in picked if len(v) == size], kind)
        fitted[x.shape[1]] = [grow(x, leaf * share, spill, reach, 1000 * size + t) for t in range(trees)]
    forests = df.sparkSession.sparkContext.broadcast(fitted)
    vectors = classes.select(F.col("rep").alias("id"), "n", "vec")
    indexed = cut(vectors.select("id", "vec").mapInArrow(_index(forests, kind), "leaf long, id long"))
    forests.destroy()
    placed = cut(_refined(indexed, vectors, kind, 4 * leaf, spill, reach))
    # blocks of a leaf: a row goes to each pair of blocks that holds its own
    blocks = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("leaf", F.ceil(F.col("k") / block).cast("int").alias("nb"))
    dealt = (
        placed.join(blocks, "leaf")
        .join(placed.groupBy("id").agg(F.collect_list("leaf").alias("own")).join(vectors, "id"), "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("leaf", "id", "n", "own", "vec", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    links = cut(dealt.groupBy("leaf", "lo", "hi").applyInArrow(_compare(kind, least), "a long, b long, k long"))
    drop(indexed, placed)
    owners = components(links.where("b is not null").select("a", "b"))
    linked = links.where("k is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("k").alias("k"))
    of_class = (
        classes.select("print", "rep", "n").join(linked, "rep", "left").join(owners.withColumnRenamed("id", "rep"), "rep", "left")
        .select("print", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    usable = F.col("id").isNotNull() & F.col("print").isNotNull()
    joined = rows.where(usable).select("id", "print").join(of_class, "print").select("id", "n_links", "component")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
