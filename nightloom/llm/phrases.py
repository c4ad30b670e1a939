"""Collocations: frequent phrases by growing contiguous patterns to the right, then scored by their weakest cut.

PrefixSpan on contiguous words, in two projections. The first holds each place where two frequent words meet, with the
third word if that is frequent: at most a row for each word of the texts, whichever pairs turn out to be frequent. It gives
the pairs and triples. The second holds the occurrences of frequent triples with the words that follow, as far as every
three words on the way can be frequent. Projections are dealt by their pair (pairs of two very common words by the third
word, too, and those pairs' sums are added up) or triple, so each prefix is the work of one task; inside a task they lie in
sorted order, which is the depth-first order of the tree of prefixes, and the sums of the open prefixes are all that is held.

Equal projections of a task are summed before they are dealt out. Words travel as 64-bit hashes, which are checked to be
distinct over the whole vocabulary (another seed is taken if they aren't). Which words and
triples are frequent is told to the tasks as a bitmap of fixed size: a false hit costs a row, counts stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import cut, drop, small, small_text, text_or_empty
from .words import Words, mix, words

U = np.uint64
LONGEST, LEAST, FIRST = 5, 100, 2000
#: Bits of a bitmap (8 MB): about a tenth of all infrequent words pass it when 7 million are frequent.
BITMAP = 26
#: Rows that a task sums before it hands on what it has.
MERGE = 1 << 18
#: Words that are more than one of so many are common: pairs of two such words are dealt by the word after them, too.
OFTEN = 500
PIECE_END = np.zeros(256, dtype=np.int32)
PIECE_END[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 1
IN_WORD = PIECE_END == 0
IN_WORD[[32, 9]] = False


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap with the bits of a column h set, as bytes: at most 2 ** (BITMAP - 6) rows come to the driver."""
    bits = hashes.select(F.pmod("h", F.lit(1 << BITMAP)).alias("bit")).selectExpr("cast(shiftright(bit, 6) as int) as at", "shiftleft(1L, cast(bit % 64 as int)) as bits")
    rows = bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.int64) & ((1 << BITMAP) - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(U) * U(0xD6E8FEB86659FD93) + mix(b.astype(U)))


def _lang_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each row's language: what is frequent is so in one language."""
    d = column.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in d.dictionary.to_pylist()], dtype=U)
    return own[d.indices.to_numpy()] if len(own) else np.zeros(0, dtype=U)


def _seeded(w: Words, seed: int) -> np.ndarray:
    h = mix(w.hash + U(seed)).astype(np.int64) if seed else w.hash.astype(np.int64)
    return np.where(h == 0, 1, h)  # 0 is no word


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, sorted by the columns in turn, with the sum of n."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at)


class _Sums:
    """Rows (language number, hashes..., n) summed within a task, and handed on when there are too many: all, or (keep) the rare ones first."""

    def __init__(self, names: list[str], keep: bool = False):
        self.names, self.held, self.rows, self.langs, self.keep = names, [], 0, {}, keep

    def codes(self, column: pa.Array) -> np.ndarray:
        d = column.dictionary_encode()
        own = np.array([self.langs.setdefault(x, len(self.langs)) for x in d.dictionary.to_pylist()], dtype=np.int64)
        return own[d.indices.to_numpy()] if len(own) else np.zeros(0, dtype=np.int64)

    def add(self, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(summed(columns, n))
        self.rows += len(self.held[-1][1])
        most = 2 * MERGE if self.keep else MERGE
        if self.rows > most:
            self._merge()
            if self.rows > most // 2:
                columns, n = self.held[0]
                often = n > np.partition(n, -(most // 4))[-(most // 4)] if self.keep else np.zeros(len(n), dtype=bool)
                self.held = [([c[~often] for c in columns], n[~often])]
                yield from self.out()
                self.held, self.rows = [([c[often] for c in columns], n[often])] if often.any() else [], int(often.sum())

    def _merge(self) -> None:
        columns = [np.concatenate(c) for c in zip(*[h[0] for h in self.held])]
        self.held = [summed(columns, np.concatenate([h[1] for h in self.held]))]
        self.rows = len(self.held[0][1])

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._merge()
        columns, n = self.held.pop()
        self.rows = 0
        names = pa.array(list(self.langs), pa.string())
        for k in range(0, len(n), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(columns[0][part])), *[pa.array(c[part]) for c in columns[1:]], pa.array(n[part])], names=self.names)


def _pieces(w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, whether the word and its next are neighbours in one piece)."""
    row = np.repeat(np.arange(rows), np.diff(w.first))
    ends = np.zeros(len(w.data) + 1, dtype=np.int32)
    np.cumsum(PIECE_END[w.data], out=ends[1:])
    near = np.zeros(len(row), dtype=bool)
    near[:-1] = (row[1:] == row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])
    return row, near


COUNTED = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("f", pa.int64()), ("word", pa.string())])


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, h, f, word): words of each language, summed within the task; words of equal hash are shown by rows with f 0."""
        seen: dict[int, bytes] = {}
        sums = _Sums(["lang", "h", "f"])

        def named(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                yield b.append_column("word", pa.array([seen[h] for h in b.column(1).to_pylist()], pa.binary()).cast(pa.string()))
            if not sums.rows:
                seen.clear()

        for batch in batches:
            lang = sums.codes(batch.column(1))
            for i, j, w in words(batch.column(0), IN_WORD):
                row, _ = _pieces(w, j - i)
                h = _seeded(w, seed)
                own, at = np.unique(h, return_index=True)
                data = w.data.tobytes()
                for x, a, b in zip(own.tolist(), w.start[at].tolist(), w.end[at].tolist()):
                    if seen.setdefault(x, data[a:b]) != data[a:b]:
                        yield pa.RecordBatch.from_pylist([{"lang": None, "h": x, "f": 0, "word": data[a:b].decode()}], COUNTED)
                yield from named(sums.add([lang[i + row], h], np.ones(len(h), dtype=np.int64)))
        yield from named(sums.out())

    return run


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """((lang, h, word, f) of all words of texts (text, lang) as a written table, seed): with that seed no two words have one hash."""
    seed = 0
    while True:
        table = cut(texts.mapInArrow(_count_words(seed), "lang string, h long, f long, word string").groupBy("lang", "h", "word").agg(F.sum("f").alias("f")))
        if table.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b").isEmpty():
            return table, seed
        drop(table)
        seed += 1


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on, over all rows."""
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = pair_hash(out, h[i : len(h) - k + 1 + i]).astype(np.int64)
    return out


def _runs(near: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each word on lie in one piece."""
    out = np.ones(max(0, len(near) - k + 1), dtype=bool)
    for i in range(k - 1):
        out &= near[i : i + len(out)]
    return out


def _hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of (lang, h1, ...) by which tasks look them up."""
    for batch in batches:
        out = batch.column(1).to_numpy()
        for c in batch.columns[2:]:
            out = pair_hash(out, c.to_numpy()).astype(np.int64)
        out = pair_hash(out, _lang_hashes(batch.column(0))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out)], names=["h"])


def _project(shared, seed: int, first: int, longest: int):
    names = [f"h{k}" for k in range(1, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, h1.., n): frequent `first` words with those after them, 0 from where the last `first` can't be frequent; at least one word after them."""
        sums, frequent = _Sums(["lang", *names, "n"], keep=True), shared.value
        for batch in batches:
            lang, tongue = sums.codes(batch.column(1)), _lang_hashes(batch.column(1))
            for i, j, w in words(batch.column(0), IN_WORD):
                row, near = _pieces(w, j - i)
                h = _seeded(w, seed)
                if len(h) <= first:
                    continue
                on = _has(frequent, pair_hash(gram_hashes(h, first), tongue[i + row[: len(h) - first + 1]]))
                goes_on = np.zeros(len(h) + longest, dtype=bool)
                goes_on[: len(h) - first] = _runs(near, first + 1) & on[:-1] & on[1:]
                at = np.flatnonzero(goes_on)
                far = np.concatenate([h, np.zeros(longest, dtype=np.int64)])
                columns, goes = [lang[i + row[at]], *[h[at + d] for d in range(first)]], np.ones(len(at), dtype=bool)
                for k in range(first, longest):
                    goes = goes & goes_on[at + k - first]
                    columns.append(np.where(goes, far[at + k], 0))
                yield from sums.add(columns, np.ones(len(at), dtype=np.int64))
        yield from sums.out()

    return run


def _grow(least: int, longest: int, first: int = 4, spread: list[int] | None = None):
    names = [f"h{k}" for k in range(1, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, h1.., f): prefixes of `first` words and more with f >= least, from projections in sorted order.

        For each length the last prefix of a batch stays open: its sum goes on in the next batch.
        Pairs of two words of `spread` are dealt to several tasks: each hands on what it has.
        """
        open_ = {d: None for d in range(first, longest + 1)}

        def grown(d: int, langs: list, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            on = n >= least
            if spread and d == 2:
                on |= np.isin(columns[0], spread) & np.isin(columns[1], spread)
            empty = np.zeros(int(on.sum()), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x for x, o in zip(langs, on) if o], pa.string()), *[pa.array(c[on]) for c in columns], *[pa.array(empty)] * (longest - d), pa.array(n[on])], names=["lang", *names, "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column(0).dictionary_encode()
            code, known = lang.indices.to_numpy(), lang.dictionary.to_pylist()
            hashes, n = [batch.column(k).to_numpy() for k in range(1, longest + 1)], batch.column(longest + 1).to_numpy()
            for d in open_:
                new = np.ones(len(n), dtype=bool)
                new[1:] = code[1:] != code[:-1]
                for c in hashes[:d]:
                    new[1:] |= c[1:] != c[:-1]
                at = np.flatnonzero(new)
                total = np.add.reduceat(n, at)
                keys, langs = [c[at] for c in hashes[:d]], [known[x] for x in code[at]]
                if open_[d] is not None:
                    was_lang, was, was_n = open_[d]
                    if (was_lang, was) == (langs[0], [int(c[0]) for c in keys]):
                        total[0] += was_n
                    elif was[-1]:
                        yield grown(d, [was_lang], [np.array([x]) for x in was], np.array([was_n]))
                open_[d] = (langs[-1], [int(c[-1]) for c in keys], int(total[-1]))
                whole = keys[-1][:-1] != 0
                yield grown(d, [x for x, o in zip(langs[:-1], whole) if o], [c[:-1][whole] for c in keys], total[:-1][whole])
        for d, held in open_.items():
            if held is not None and held[1][-1]:
                yield grown(d, [held[0]], [np.array([x]) for x in held[1]], np.array([held[2]]))

    return run


def _often(known: DataFrame, totals: DataFrame) -> list[int]:
    """Hashes of the words that are, in one language, at least one of OFTEN of all words: at most that many."""
    (every,) = totals.agg(F.sum("n")).first()
    return [r.h for r in known.where(F.col("f") * OFTEN >= F.lit(every or 0)).select("h").distinct().collect()]


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f) of the phrases of 1 to `longest` words with f >= least, (lang, n) of all words), as written tables."""
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    all_words, seed = vocabulary(texts)
    totals = cut(all_words.groupBy("lang").agg(F.sum("f").alias("n")))
    known = cut(all_words.where(F.col("f") >= least))
    drop(all_words)
    # the shuffle of all words is on the executors' disks until the driver's JVM sees that nobody holds it
    spark.sparkContext._jvm.System.gc()
    found, shorter = None, known.select("lang", "h").mapInArrow(_hash_grams, "h long")
    # from each frequent word the pairs and triples, from each frequent triple all that is longer
    for first, last in ((1, min(3, longest)), (3, longest))[: 1 + (longest > 3)]:
        likely = spark.sparkContext.broadcast(bitmap_of(shorter))
        names = [f"h{k}" for k in range(1, last + 1)]
        kinds = ", ".join(f"{k} long" for k in names)
        projected = texts.mapInArrow(_project(likely, seed, first, last), f"lang string, {kinds}, n long")
        if first == 1:
            often = _often(known, totals) if last == 3 else []
            dealt = projected.withColumn("deal", F.when(F.col("h1").isin(often) & F.col("h2").isin(often), F.col(names[-1])).otherwise(0)).repartition("lang", "h1", "h2", "deal")
            grown = _grow(least, last, 2, often)
        else:
            dealt, grown = projected.repartition("lang", "h1", "h2", "h3"), _grow(least, last)
        # by a hash first: Spark compares whole rows only where the first key is the same
        rows = dealt.sortWithinPartitions(F.xxhash64("h1", "h2"), "h1", "h2", "lang", *names[2:]).select("lang", *names, "n").mapInArrow(grown, f"lang string, {kinds}, f long")
        if first == 1:
            rows = cut(rows.groupBy("lang", *names).agg(F.sum("f").alias("f")).where(F.col("f") >= least))
            shorter = rows.where(F.col(names[-1]) != 0).select("lang", *names).mapInArrow(_hash_grams, "h long")
        rows = rows.select("lang", F.filter(F.array(*names), lambda h: h != 0).alias("hs"), "f")
        found = rows if found is None else found.unionAll(rows)
    found = cut(found)
    # hashes back to words: a phrase's words by their places
    place = found.select("lang", "hs", "f", F.posexplode("hs").alias("k", "h"))
    spelt = place.join(small_text(cut(known.select("h", "word").distinct()), "word"), "h").groupBy("lang", "hs", "f").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("ws"))
    phrases = spelt.select("lang", F.transform("ws", lambda x: x["word"]).alias("words"), "f").unionAll(known.select("lang", F.array("word").alias("words"), "f"))
    return cut(phrases), totals


def cut_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exactly: 38 digits, counts of up to 17 digits."""
    wide = lambda c: c.cast("decimal(17,0)")
    top = F.lit(1000).cast("decimal(4,0)") * (wide(a) * wide(n))
    return F.call_function("div", top, (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """Per language its `first` best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words with f(phrase) >= least is cut after each of its words; the lowest score counts (ties:
    the smallest k). Phrases inside a longer one that is as frequent are left out: it is enough to look one word further,
    as all lengths between are as frequent too. A null text is empty, a null language is `und`, repeated rows
    count each, texts of any length are read whole; languages without phrases have no rows; an empty table gives an
    empty one; other columns, whatever their names, are ignored.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, least, longest)
    text = lambda ws: F.array_join(ws, " ")
    phrases = phrases.select("lang", "words", text(F.col("words")).alias("phrase"), "f")
    counts = small_text(phrases.select("lang", "phrase", "f"), "phrase")
    long = phrases.where(F.size("words") > 1)
    ends = F.array(text(F.expr("slice(words, 1, size(words) - 1)")), text(F.expr("slice(words, 2, size(words) - 1)")))
    within = long.where(F.size("words") > 2).select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = long.join(within, ["lang", "phrase"], "left").where("longer is null or longer < f").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), text(F.slice("words", F.lit(1), k)).alias("left"), text(F.slice("words", k + 1, F.size("words"))).alias("right")))
    cuts = kept.select("lang", "phrase", "a", F.explode(parts).alias("c")).select("lang", "phrase", "a", "c.*")
    left, right = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(small(totals), "lang")
    score = cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    best = scored.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("s")).groupBy("lang", "phrase", "a", "n").agg(F.min("s").alias("s"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
