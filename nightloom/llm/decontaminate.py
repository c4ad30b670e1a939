"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against training windows.

Benchmark windows are gathered in blocks of at most `block` windows. Every block is one broadcast
and one narrow scan step over the documents; beyond one block each step is written before the next,
so any number of benchmark windows is handled without a shuffle of texts, and one block is alive at
a time. A hash hit is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, text_or_empty
from .words import ALNUM, words

WINDOW = 13
#: Windows of one broadcast: 100 bytes each or so.
BLOCK = 500_000
BITS = 22


class Block(NamedTuple):
    """Windows of one length, sorted by hash: item and the window's words, joined by blanks."""

    length: int
    hashes: np.ndarray
    items: list[int | None]
    texts: list[bytes]


def _windows(width: int):
    """Rows (length, hash, item, text), one for each distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, w in words(batch.column(1), ALNUM):
                rows: set[tuple] = set()
                for r in range(j - i):
                    a, b = w.of(r)
                    n = min(width, b - a)
                    if n:
                        grams = w.ngrams(n)
                        for k in range(a, b - n + 1):
                            text = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[k : k + n], w.end[k : k + n]))
                            rows.add((n, int(grams[k].view(np.int64)), ids[i + r], text))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("length", "hash", "item", "text"), x)) for x in rows],
                    schema=pa.schema([("length", pa.int32()), ("hash", pa.int64()), ("item", pa.int64()), ("text", pa.binary())]),
                )

    return run


def _blocks(windows: DataFrame, block: int) -> Iterator[list[Block]]:
    """The windows on the driver, one bounded block at a time."""
    rows: list = []
    for row in windows.toLocalIterator():
        rows.append(row)
        if len(rows) >= block:
            yield _pack(rows)
            rows = []
    if rows:
        yield _pack(rows)


def _pack(rows: list) -> list[Block]:
    packed = []
    for n in sorted({r["length"] for r in rows}):
        own = sorted(((np.int64(r["hash"]).view(np.uint64), r["item"], bytes(r["text"])) for r in rows if r["length"] == n), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        packed.append(Block(n, np.array([x[0] for x in own], dtype=np.uint64), [x[1] for x in own], [x[2] for x in own]))
    return packed


HITS = "array<struct<start:int,end:int,item:bigint>>"


def _scanner(shared):
    """Text to (n_words, hits): this block's verified hits, word ranges and items."""

    @F.arrow_udf(f"struct<n_words:bigint,hits:{HITS}>")
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.int64())]))
        sieves = []
        for block in shared.value:
            sieve = np.zeros(1 << BITS, dtype=bool)
            sieve[block.hashes & np.uint64((1 << BITS) - 1)] = True
            sieves.append((block, sieve))
        for text in texts:
            counts = np.zeros(len(text), dtype=np.int64)
            new: dict[int, set] = {}
            for i, j, w in words(text, ALNUM):
                counts[i:j] = np.diff(w.first)
                for block, sieve in sieves:
                    grams = w.ngrams(block.length)
                    at = np.flatnonzero(sieve[grams & np.uint64((1 << BITS) - 1)])
                    if not len(at):
                        continue
                    found = np.searchsorted(block.hashes, grams[at])
                    same = block.hashes[np.minimum(found, len(block.hashes) - 1)] == grams[at]
                    at, found = at[same], found[same]
                    row = np.searchsorted(w.first, at, side="right") - 1
                    inside = at + block.length <= w.first[row + 1]
                    for k, f, r in zip(at[inside], found[inside], row[inside]):
                        own = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[k : k + block.length], w.end[k : k + block.length]))
                        h = block.hashes[f]
                        while f < len(block.hashes) and block.hashes[f] == h:
                            if block.texts[f] == own:
                                p = int(k - w.first[r])
                                new.setdefault(i + int(r), set()).add((p, p + block.length, block.items[f]))
                            f += 1
            order = lambda x: (x[:2], x[2] is not None, x[2] or 0)
            hits = [[dict(zip(("start", "end", "item"), x)) for x in sorted(new.get(r, ()), key=order)] for r in range(len(text))]
            yield pa.StructArray.from_arrays([pa.array(counts), pa.array(hits, hit_type)], names=["n_words", "hits"])

    return scan


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block: int = BLOCK, keep_text: bool = True
) -> DataFrame:
    """docs with n_words and hits: array of (start, end, item), word ranges that are a benchmark window.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null texts have no words; benchmark rows without words have no window; those without an id
    hit like others, with a null item; an empty benchmark hits nothing. Repeated items add nothing.
    Columns of docs stay as they are, except that `hits` and `n_words` are the operator's: equally named
    columns of docs are replaced. Rows keep their number, repeated or not. Only the text goes to Python.
    """
    windows = benchmark.select(F.col(item_col).cast("long").alias("item"), text_or_empty(item_text_col).alias("text")).mapInArrow(
        _windows(width), "length int, hash long, item long, text binary"
    )
    carried = [c for c in docs.columns if c not in ("hits", "n_words") and (keep_text or c != text_col)]
    names = [f"c{i}" for i in range(len(carried))]
    text, none = F.col("text_"), F.array().cast(HITS)
    flow = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carried, names)], F.col(text_col).cast("string").alias("text_"), none.alias("hits"))
    sent = None
    for packed in chain(_blocks(windows.dropDuplicates(["length", "hash", "item", "text"]), block), [None]):
        if packed is None and sent is not None:
            break
        if sent is not None:  # one block and one scan step at a time
            flow = cut(flow)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(packed or [])
        found = flow.withColumn("found_", _scanner(sent)(text))
        flow = found.select(*names, "text_", F.concat("hits", "found_.hits").alias("hits"), F.col("found_.n_words").alias("n_words"))
    return flow.select(*[F.col(x).alias(c) for c, x in zip(carried, names)], "n_words", "hits")


def covered_words(hits: str = "hits") -> Column:
    """Number of words inside any of the ranges."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["end"] - 1))))).cast("long")


def judge(docs: DataFrame, benchmark: DataFrame, least_parts: int = 20, **kw) -> DataFrame:
    """find_contamination with n_hit, items (sorted as strings, without null ids) and contaminated.

    contaminated: n_hit > 0 and least_parts * n_hit >= n_words.
    """
    found = find_contamination(docs, benchmark, **kw)
    return found.withColumns(
        {"n_hit": covered_words(), "items": F.sort_array(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item"].cast("string")), lambda x: x.isNotNull())))}
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_parts >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that aren't contaminated, with the columns of docs."""
    return judge(docs, benchmark, **kw).where(~F.col("contaminated")).select(*docs.columns)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, out = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for r, ranges in enumerate(hits):
            if not ranges or out[r] is None:
                continue
            raw = out[r].encode()
            for _, _, w in words(pa.array([out[r]]), ALNUM):
                keep, upto = [], 0
                for x in sorted(ranges, key=lambda x: x["start"]):
                    s, e = int(w.start[x["start"]]), int(w.end[x["end"] - 1])
                    if e > upto:
                        keep.append(raw[upto : max(s, upto)])
                        upto = e
                out[r] = b"".join([*keep, raw[upto:]]).decode()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs with every benchmark window cut out of the text."""
    found = find_contamination(docs, benchmark, text_col=text_col, **kw)
    rest = [c for c in docs.columns if c != text_col]
    kinds = ", ".join(["text string", *[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]])
    cleaned = found.select(F.col(text_col).alias("text"), "hits", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).mapInArrow(_without, kinds)
    return cleaned.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"c{rest.index(c)}").alias(c) for c in docs.columns])
