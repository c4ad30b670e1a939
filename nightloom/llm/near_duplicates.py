"""Near-duplicate documents: an inverted join over MinHash signature coordinates.

Each text is a set of word shingles with a signature of `coordinates` minima. Texts with equal
sets form a class and one representative goes on. Representatives are posted under each pair of
coordinate and value. Pairs that agree in at least `match` coordinates are wanted, so

* a value that no other text has can't match: such postings go (skip),
* of the others only the rarest `count - match + 1` are kept: two texts that agree in `match`
  places share at least one of these (prefix),
* lists are first merged against one pivot each, which ties large groups of copies together with
  one candidate for each text (as in a spanning forest),
* then only pairs of a list in different components count (the others can't change any component):
  those of short lists if they collide often enough, one by one inside the list's task; those of long
  lists block by block, without ever being written as pairs,
* and all are confirmed on the full shingle sets, in cells of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import components, cut, drop, large, small
from .words import C1, C2, NOT_BLANK, U, mix, words

COORDINATES = 32
#: A pair of similarity 0.8 agrees in fewer than 14 of 32 coordinates about three times in a million.
MATCH = 14
#: Texts around one pivot that are compared in one cell, about.
STAR = 512
#: Texts of a list from which on it is compared block by block; shorter ones give candidates one by one.
HEAVY = 64
#: Shingles of a block, about.
BLOCK = 1 << 19


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for i, j, w in words(column, NOT_BLANK):
        grams = w.ngrams(width)
        for r in range(j - i):
            a, b = w.of(r)
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:  # the whole sequence is the one shingle
                h = U(b - a)
                with np.errstate(over="ignore"):
                    for x in w.hash[a:b]:
                        h = h * C1 + x * C2
                yield mix(np.array([h], dtype=U))
            else:
                yield np.zeros(0, dtype=U)


def signer(coordinates: int):
    """A function from a shingle set to its `coordinates` minima of 32 bits."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 1 << 63, coordinates, dtype=np.int64).astype(U) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, coordinates, dtype=np.int64).astype(U) * U(2)

    def sign(s: np.ndarray) -> np.ndarray:
        least = np.full(coordinates, ~U(0))
        for k in range(0, len(s), 2048):
            np.minimum(least, (s[k : k + 2048, None] * a + b).min(axis=0), out=least)
        return (least >> U(32)).astype(np.uint32).view(np.int32)

    return sign


def _features(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(coordinates)
        for batch in batches:
            n, prints, signatures = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(sign(s) if len(s) else np.zeros(0, dtype=np.int32))
            sizes = np.cumsum([0] + [len(s) for s in signatures]).astype(np.int32)
            flat = np.concatenate(signatures) if signatures else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(sizes, pa.array(flat))],
                names=["id", "n", "print", "signature"],
            )

    return run


def _sets(width: int):
    """Rows (id, comp, places, text) to (shingles, id, comp, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = list(shingle_sets(part.column(3), width))
                sizes = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(sizes, pa.array(flat)), *part.columns[:3]], names=["shingles", "id", "comp", "places"])

    return run


class Held:
    """The right-hand sets of a cell: ids, components, sizes, and all shingles in order with their owners."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.comps, self.sizes, flat = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.ids)), self.sizes)[order]

        # components of the cell as trees: what a link has joined needs no other one
        self.up: dict[int, int] = {}

    def top(self, comp: int) -> int:
        at = comp
        while self.up.setdefault(at, at) != at:
            at = self.up[at]
        while self.up[comp] != at:
            self.up[comp], comp = at, self.up[comp]
        return at

    def links(self, comp: int, own: np.ndarray, percent: int) -> np.ndarray:
        """Ids alike enough to a set that join its component with others that no link of this cell has joined with it."""
        lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.ids))
        good = np.flatnonzero((both * 100 >= percent * (len(own) + self.sizes - both)) & (self.comps != comp))
        new = []
        for k in good[np.unique(self.comps[good], return_index=True)[1]].tolist():
            mine, other = self.top(comp), self.top(int(self.comps[k]))
            if mine != other:
                self.up[max(mine, other)] = min(mine, other)
                new.append(k)
        return self.ids[new]


def _cells(percent: int):
    """Rows (cell, side, id, comp, shingles), sorted by cell and side, to links (a, b) between side 1 and side 0 of a cell.

    A cell's side 0 is held (its size is bounded by whoever placed it), side 1 passes by; the links are a forest over components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None
        for batch in batches:
            cells, sides, ids, comps = (batch.column(i).to_numpy() for i in range(4))
            sets = batch.column(4)
            flat, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(cells)]
            found_a, found_b = [], []
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if cells[i] != cell:
                    cell, parts, held = cells[i], [], None
                if sides[i] == 0:
                    parts.append((ids[i:j].copy(), comps[i:j].copy(), np.diff(ends[i : j + 1]), flat[ends[i] : ends[j]].copy()))
                    continue
                if held is None and parts:
                    held = Held(parts)
                for r in range(i, j) if held else ():
                    near = held.links(int(comps[r]), flat[ends[r] : ends[r + 1]], percent)
                    found_b.append(near)
                    found_a.append(np.full(len(near), ids[r]))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def confirmed(texts: DataFrame, places: DataFrame, owners: DataFrame | None, width: int, percent: int) -> DataFrame:
    """Links (a, b) between texts placed in the same cell on sides 1 and 0: 100 * intersection >= percent * union of their full sets.

    places: (id, cell, side). Of a cell's links those of a forest over the components of owners are returned, within
    a component none: what is joined already needs no more links, so links don't outnumber the places. Every set is made once, from its
    text, and sent once for each cell. The table of places is broadcast below a checked size.
    """
    own = places.groupBy("id").agg(F.collect_set(F.struct("cell", "side")).alias("places"))
    own = own.withColumn("comp", F.col("id")) if owners is None else own.join(small(owners), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    own = cut(own.select("id", "comp", "places"))
    rows = texts.join(small(own, weight=F.size("places") + 1), "id").select("id", "comp", "places", "text").mapInArrow(_sets(width), "shingles array<bigint>, id long, comp long, places array<struct<cell:bigint,side:int>>")
    rows = rows.select(F.explode("places").alias("p"), "id", "comp", "shingles").select("p.cell", "p.side", "id", "comp", "shingles")
    return cut(rows.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_cells(percent), "a long, b long"))


def _collisions(match: int, percent: int):
    """Rows (token, id, n, comp, main, signature), sorted by token, to rows (x, ys): partners of x in one list.

    Pairs of one component, and pairs inside the list's main one, are skipped. What remains must agree in
    `match` coordinates.
    """

    def pairs(token, ids, n, comp, main, signature):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(token) != 0]))
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        rare = np.flatnonzero(comp != main)
        k = sizes[group[rare]]
        i = np.repeat(rare, k)
        j = np.repeat(starts[group[rare]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        on = (comp[i] != comp[j]) & ((comp[j] == main[j]) | (ids[i] < ids[j])) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        i, j = i[on], j[on]
        same = np.concatenate([(signature[i[s : s + 65536]] == signature[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        i, j = i[same >= match], j[same >= match]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0])) if len(i) else np.zeros(0, dtype=np.int64)
        ys = pa.ListArray.from_arrays(pa.array(np.concatenate([edges, [len(i)]]).astype(np.int32)), pa.array(ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(ids[i[edges]]), ys], names=["x", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(5)] + [batch.column(5).flatten().to_numpy().reshape(batch.num_rows, -1)]
            now = now if kept is None else [np.concatenate(c) for c in zip(kept, now)]
            last = int(np.searchsorted(now[0], now[0][-1], "left"))  # the list at the end may go on
            if last:
                yield pairs(*[c[:last] for c in now])
            kept = [c[last:] for c in now]
        if kept is not None:
            yield pairs(*kept)

    return run


def _colliding(pairs: DataFrame, signatures: DataFrame, match: int) -> DataFrame:
    """Those pairs whose signatures agree in at least match coordinates, with that number: (a, b, same)."""
    same = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x: x))
    return (
        pairs.join(large(signatures.withColumnsRenamed({"id": "a", "signature": "ga"})), "a")
        .join(large(signatures.withColumnsRenamed({"id": "b", "signature": "gb"})), "b")
        .select("a", "b", same.alias("same"))
        .where(F.col("same") >= match)
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    coordinates: int = COORDINATES, match: int = MATCH, heavy: int = HEAVY, block: int = BLOCK,
) -> DataFrame:
    """Per row of docs: (id_col, n_shingles, component_id, kept).

    A text's set is its distinct shingles of `width` words; fewer words are one shingle; a null,
    empty or blank text has an empty set and links with nothing. Texts link when
    100 * |intersection| >= percent * |union|; component_id is the smallest id reachable, kept marks
    the row whose id it is. A null id links with nothing, gets a null component and is kept. Repeated
    rows share their id's result. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = cut(texts.mapInArrow(_features(width, coordinates), "id long, n long, print binary, signature array<int>"))
    classes = cut(features.where("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    signatures = classes.select(F.col("rep").alias("id"), "signature")

    posts = classes.select("rep", "n", F.posexplode("signature").alias("k", "value")).select(
        (F.col("k").cast("long") * F.lit(1 << 32) + F.col("value")).alias("token"), "rep", "n"
    )
    counts = posts.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    kept = (
        posts.join(large(counts), "token")
        .groupBy("rep")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"))  # at most `coordinates`
        .where(F.size("tokens") >= match)
    )
    prefix = F.slice("tokens", 1, F.size("tokens") - F.lit(match - 1))
    lists = cut(kept.select("rep", "n", F.explode(prefix).alias("t")).select(F.col("t.token").alias("token"), "rep", "n"))
    # one pivot for each list, one candidate for each text: a forest that ties groups of copies together
    first = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", F.col("n").alias("m"))).alias("p"))
    best = (
        lists.join(large(first.select("token", F.col("p.rep").alias("pivot"), "p.m")), "token")
        .where(f"rep <> pivot and least(n, m) * 100 >= greatest(n, m) * {percent}")
        .groupBy("rep", "pivot")
        .agg(F.count(F.lit(1)).alias("hits"))
        .groupBy("rep")
        .agg(F.max_by("pivot", F.struct("hits", "pivot")).alias("pivot"))
        .select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    )
    best = cut(_colliding(best, signatures, match))
    cell = F.xxhash64("b", F.pmod(F.xxhash64("a"), F.ceil(F.col("k") / STAR))).alias("cell")
    stars = best.join(small(cut(best.groupBy("b").agg(F.count(F.lit(1)).alias("k")))), "b").select("a", "b", cell)
    places = stars.select(F.col("a").alias("id"), "cell", F.lit(1).alias("side")).unionAll(stars.select("b", "cell", F.lit(0)).distinct())
    owners = cut(components(confirmed(texts, places, None, width, percent)))

    # lists with several components: pairs inside the commonest one are skipped, as they can't change any component
    now = lists.join(small(owners.withColumnRenamed("id", "rep")), "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("c"))
    parts = now.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = cut(now.join(main.select("token", "main", "k"), "token"))
    places = _light(split.where(F.col("k") < heavy), signatures, match, percent).unionAll(_heavy(split.where(F.col("k") >= heavy), block))
    links = confirmed(texts, places, owners, width, percent)
    links = links.unionAll(owners.where("id <> component").select("id", "component"))
    owners = cut(components(links))
    drop(lists, split)

    of_class = classes.select("print", "rep").join(small(owners.withColumnRenamed("id", "rep")), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    whole = features.where("print is not null").select("id", "n", "print").join(of_class, "print", "left")
    alone = features.where("print is null").select("id", "n", F.lit(None).cast("binary").alias("print"), F.lit(None).cast("long").alias("component_id"))
    return whole.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.col("id").eqNullSafe(F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest id. All columns stay.

    Rows with a null id stay. Of rows that repeat an id one stays. Texts move only if ids repeat or the
    ids to go are too many to broadcast.
    """
    gone = cut(near_duplicates(docs, id_col, text_col, **kw).where(~F.col("kept")).select(id_col).distinct())
    left = docs.join(small(gone), id_col, "left_anti").select(*docs.columns)
    repeated = cut(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(id_col))
    if not repeated.limit(1).count():
        return left
    once = left.join(small(repeated), id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
    return left.join(small(repeated), id_col, "left_anti").select(*docs.columns).unionByName(once)


def _light(split: DataFrame, signatures: DataFrame, match: int, percent: int) -> DataFrame:
    """Places for pairs of short lists: a text and its partners meet in the cell of the smallest id around the text.

    A text is in less than `coordinates` lists of less than `heavy` texts, which bounds its partners and a cell.
    """
    rows = split.join(large(signatures.withColumnRenamed("id", "rep")), "rep").select("token", "rep", "n", "c", "main", "signature")
    met = rows.repartition("token").sortWithinPartitions("token").mapInArrow(_collisions(match, percent), "x long, ys array<bigint>")
    partners = cut(met.groupBy("x").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys")))
    edges = partners.select("x", F.explode("ys").alias("y"))
    label = edges.groupBy("x").agg(F.min("y").alias("m")).unionAll(edges.groupBy("y").agg(F.min("x"))).groupBy("x").agg(F.least("x", F.min("m")).alias("m"))
    celled = partners.join(large(label), "x").select("x", "ys", F.xxhash64("m").alias("cell"))
    return celled.select(F.col("x").alias("id"), "cell", F.lit(1).alias("side")).unionAll(celled.select(F.explode("ys"), "cell", F.lit(0)))


def _heavy(split: DataFrame, block: int) -> DataFrame:
    """Places for long lists: those with the same main component are one family, in which every text outside that
    component meets all the texts of the family, block by block; no pairs are written.

    A block holds sets of about `block` shingles.
    """
    family = cut(split.select("main", "rep", "n", "c").distinct())
    weight = F.col("n") + 256
    sizes = family.groupBy("main").agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("c") != F.col("main"), weight)).alias("rare"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1))
    dealt = family.join(small(cut(sizes.select("main", blocks("all").alias("nb"), blocks("rare").alias("nr")))), "main")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = F.xxhash64("main", "i", "j").alias("cell")
    right = dealt.select("rep", "main", own("nb").alias("j"), upto("nr").alias("i"))
    left = dealt.where("c <> main").select("rep", "main", own("nr").alias("i"), upto("nb").alias("j"))
    return right.select(F.col("rep").alias("id"), cell, F.lit(0).alias("side")).unionAll(left.select("rep", cell, F.lit(1)))
