"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear between knots. The
integral of a schedule is the source's share; shares of all words are the targets, none above
`max_passes` times the source's size (the excess is reshared by weight). A source's cumulative
demand follows its integrated schedule, and inverting it gives each document copy its training
position: the time at which the demand reaches the copy's place in the source's stream. Copies are
range-sorted by position.

Streams are ordered by a hash of the document id. Running sums go by (source, hash bucket): a partial
aggregate for the buckets, a running sum over the few buckets of a source, and a window inside each
bucket, so a source with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import cut, small

BUCKETS = 256
KNOTS = (0.0, 0.5, 1.0)
#: Weight at each knot for each class: the first falls, the second is level, the third rises; integrals 1, 2, 3.
CLASSES = ((1.5, 1.0, 0.5), (2.0, 2.0, 2.0), (1.5, 3.0, 4.5))


def integral(weights: Sequence[float], knots: Sequence[float] = KNOTS) -> float:
    return sum((b - a) * (x + y) / 2 for a, b, x, y in zip(knots, knots[1:], weights, weights[1:]))


def time_of(share: Column, weights: Sequence[float], knots: Sequence[float] = KNOTS) -> Column:
    """The time at which `share` (0..1) of a schedule's integral is reached: a quadratic for each piece."""
    total, done, out = integral(weights, knots), 0.0, None
    for a, b, x, y in zip(knots, knots[1:], weights, weights[1:]):
        area = (b - a) * (x + y) / 2
        need = F.greatest(share * total - F.lit(done), F.lit(0.0))
        slope = (y - x) / (b - a)
        step = need / x if slope == 0 else (F.sqrt(F.greatest(F.lit(x * x) + need * (2 * slope), F.lit(0.0))) - x) / slope
        here = F.least(F.lit(a) + step, F.lit(b))
        out = F.when(share * total <= done + area, here) if out is None else out.when(share * total <= done + area, here)
        done += area
    return out.otherwise(F.lit(knots[-1]))


def n_words(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    classes: Sequence[Sequence[float]] = CLASSES, knots: Sequence[float] = KNOTS, max_passes: int = 3, buckets: int = BUCKETS,
) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, position, copies; sorted by position.

    size: words of the text, null: 0. Sources by code point, null last, take the classes in turn.
    copies: array of (words, position): whole copies, and at most one copy cut after `words` words, where
    the source's target ends; so a source's taken words are its target, rounded down. position: the first
    copy's, null if nothing is taken. Rows of equal id and size (repeated rows) take their turns one after
    the other; rows with a null id are ordered by their text. A source without words has target 0. An
    empty table gives an empty one. Other columns are ignored, whatever their names. The table of sources (one row each) is held by one task.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    base = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), key.alias("h"))
        .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))  # in the order of h
    )
    parts = cut(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    # one row for each source: class, then the level of the targets
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = [integral(c, knots) for c in classes]
    nth = F.pmod(rank, F.lit(len(classes)))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in totals]), (nth + 1).cast("int"))
    ranked = sources.select("*", nth.alias("class"), weight.alias("weight")).withColumn("cap", F.col("source_size") * max_passes)
    # fill to a level: sources in order of cap / weight reach their cap until the rest share what is left by weight
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    level = (
        ranked.withColumns({"all": F.sum("source_size").over(everything), "w_all": F.sum("weight").over(everything)})
        .withColumns({"caps": F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), "ws": F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, -1))})
        .withColumn("share", (F.col("all") - F.coalesce("caps", F.lit(0))).cast("double") / (F.col("w_all") - F.coalesce("ws", F.lit(0.0))))
        .withColumn("free", F.col("cap") > F.col("share") * F.col("weight"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(everything)["share"])
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")))
        .select("source", "source_size", "class", "target")
    )
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = (
        parts.alias("p").join(level.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")))
        .select("p.source", "bucket", "words", "source_size", "class", "target").withColumn("before", before)
    )
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
        .join(small(cut(offsets)).alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
        .select("doc_id", "size", "source_size", "class", "target", (F.col("before") + F.col("inside")).alias("at"))
    )

    def timed(share: Column) -> Column:
        out = time_of(share, classes[0], knots)
        for i, c in list(enumerate(classes))[1:]:
            out = F.when(F.col("class") == i, time_of(share, c, knots)).otherwise(out)
        return out

    def copy(k: Column) -> Column:
        """The k-th copy: its place in the source's stream, inverted to a position; words up to where the demand ends."""
        place = k * F.col("source_size") + F.col("at")
        n = F.least(F.col("size"), F.floor("target") - place)
        return F.struct(n.alias("words"), timed(F.try_divide(place + n / 2, F.col("target"))).alias("position"))

    passes = F.sequence(F.lit(0).cast("long"), F.lit(max_passes - 1).cast("long"))
    out = (
        placed.withColumn("copies", F.filter(F.transform(passes, copy), lambda c: c["words"] > 0))
        .withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]))
        .withColumn("position", F.get(F.transform("copies", lambda c: c["position"]), F.lit(0)))
    )
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", "position", "copies").repartitionByRange("position", "doc_id").sortWithinPartitions("position", id_col)


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each copy, range-sorted by position: (id_col, copy, words, position)."""
    return mixed.select(id_col, F.posexplode("copies").alias("copy", "c")).select(id_col, "copy", "c.words", "c.position").repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)
