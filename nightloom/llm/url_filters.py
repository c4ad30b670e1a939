"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

DataFrame functions only. The rules judge part of the URLs; what they judge is the labelled set from
which the trees are trained, and the trees judge what no rule fits. Features are small whole numbers
(bins by fixed formulas), so each level of a tree is one aggregate: sums of gradients by (node,
feature, bin), of which the driver gets a table whose size depends on the model alone. Gradients are
scaled to whole numbers: sums, splits and verdicts don't depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, drop, small_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 64
#: Labelled URLs the trees are fitted on, at most about: those whose id's hash lies below a bound.
SAMPLE = 50_000
TREES, DEPTH, RATE, SMOOTH = 16, 3, 0.4, 1.0
#: A gradient of one, as a whole number.
UNIT = 1 << 20
#: Folds of the labelled URLs: a labelled URL's suffix rates come from the other folds.
FOLDS = 5
#: Trees grown between two writings of the scores: expressions stay short.
WRITE_EVERY = 4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


class Split(NamedTuple):
    """A node of a tree: goes left if bin of feature <= at. A leaf has feature -1 and a value."""

    feature: int
    at: int
    value: float


class Model(NamedTuple):
    base: float
    trees: list[dict[int, Split]]  # node -> Split; the children of node k are 2k and 2k + 1, the root is 1


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; null or without '://': empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(text, verdict) of the longest rule that fits, else null. Rules are a small list: part of the plan."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<text:string,verdict:string>") if out is None else out


def entropy(text: Column) -> Column:
    """Bits a character, from the runs of the sorted characters: linear work after the sort."""
    n = F.length(text)
    log_of = lambda k: k * F.log2(k.cast("double"))
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("s"))

    def step(acc: Column, c: Column) -> Column:
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["run"] + 1).otherwise(1).alias("run"), F.when(same | (acc["run"] == 0), acc["s"]).otherwise(acc["s"] + log_of(acc["run"])).alias("s"))

    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda acc: acc["s"] + F.when(acc["run"] > 0, log_of(acc["run"])).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features by fixed formulas, each a number of bins from 0 to BINS - 1."""
    url, query = F.coalesce(url, F.lit("")), query_of(url)
    steps = lambda n: F.floor(F.log2(n.cast("double") + 1) * 4)  # noqa: E731  quarter powers of two
    share = lambda n, of: F.floor(F.try_divide(n * 32, F.greatest(of, F.lit(1))))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    found = {
        "length": steps(F.length(url)),
        "host_length": F.length(host),
        "path_length": steps(F.length(path)),
        "depth": count(path, "/"),
        "labels": F.when(host == "", 0).otherwise(count(host, r"\.") + 1),
        "digit_ratio": share(count(url, "[0-9]"), F.length(url)),
        "host_digits": share(count(host, "[0-9]"), F.length(host)),
        "hyphens": count(host, "-"),
        "entropy": F.floor(entropy(url) * 8),
        "host_entropy": F.floor(entropy(host) * 8),
        "parameters": count(query, "[^&]+"),
        "secure": url.startswith("https://").cast("int"),
    }
    return {k: F.least(v, F.lit(BINS - 1)).cast("int") for k, v in found.items()}


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Ends whose statistics are features: the host's last label and last two, and the path's ending from its last dot."""
    return {
        "top": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1),
    }


def _suffix_bins(base: DataFrame) -> tuple[DataFrame, list[str]]:
    """base with, for each suffix, bins of its frequency over all rows and of its rate of blocked labelled rows.

    A labelled row's rate leaves out the labelled rows of its own fold. Sums by (suffix, fold) are combined before
    they shuffle; a suffix is one row of the table that joins back.
    """
    names, n, k = [], F.count("label"), F.coalesce(F.sum("label"), F.lit(0))
    for s in ("top", "domain", "ending"):
        by_fold = base.groupBy(s, "fold").agg(F.count(F.lit(1)).alias("rows_"), n.alias("n_"), k.alias("k_"))
        table = cut(by_fold.groupBy(s).agg(F.sum("rows_").alias("rows_"), F.sum("n_").alias("n_"), F.sum("k_").alias("k_"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n_", "k_")))).alias("folds_")))
        own = F.when(F.col("label").isNotNull(), F.col("folds_")[F.col("fold")])
        n_, k_ = F.col("n_") - F.coalesce(own["n_"], F.lit(0)), F.col("k_") - F.coalesce(own["k_"], F.lit(0))
        rate = F.floor((k_ * 2 + 2) * 16 / (n_ * 2 + 4))  # two rows of prior, half of them blocked; 0 .. 15
        rows = F.floor(F.log2(F.col("rows_").cast("double")))
        base = base.join(small_text(table, s, row=256), s).withColumns({f"{s}_rate": F.least(rate, F.lit(15)).cast("int"), f"{s}_rows": F.least(rows, F.lit(BINS - 1)).cast("int")}).drop("rows_", "n_", "k_", "folds_")
        names += [f"{s}_rate", f"{s}_rows"]
    return base, names


def _node(tree: dict[int, Split], bins: Column, k: int = 1) -> Column:
    """The number of the leaf or open node that a row reaches."""
    s = tree.get(k)
    if s is None or s.feature < 0:
        return F.lit(k)
    return F.when(F.get(bins, F.lit(s.feature)) <= s.at, _node(tree, bins, 2 * k)).otherwise(_node(tree, bins, 2 * k + 1))


def _value(tree: dict[int, Split], bins: Column, k: int = 1) -> Column:
    s = tree[k]
    if s.feature < 0:
        return F.lit(s.value)
    return F.when(F.get(bins, F.lit(s.feature)) <= s.at, _value(tree, bins, 2 * k)).otherwise(_value(tree, bins, 2 * k + 1))


def raw_score(model: Model, bins: Column) -> Column:
    out = F.lit(model.base)
    for t in model.trees:
        out = out + _value(t, bins)
    return out


def _leaf(g: int, h: int) -> float:
    return RATE * g / (h + SMOOTH * UNIT)


def best_split(histogram: dict[tuple[int, int], tuple[int, int]], features: int) -> tuple[int, int, tuple, tuple] | None:
    """(feature, bin, sums left, sums right) of the largest gain; ties by feature, then bin. None if nothing is gained.

    histogram: (feature, bin) -> (sum of gradients, sum of hessians) in units.
    """
    best, found = 0.0, None
    gain = lambda g, h: g * g / (h + SMOOTH * UNIT)
    for f in range(features):
        bins = sorted(b for ff, b in histogram if ff == f)
        g_all, h_all = (sum(histogram[f, b][i] for b in bins) for i in (0, 1))
        g = h = 0
        for b in bins[:-1]:
            g, h = g + histogram[f, b][0], h + histogram[f, b][1]
            if min(h, h_all - h) < UNIT // 2:  # half a row of doubt on either side
                continue
            got = gain(g, h) + gain(g_all - g, h_all - h) - gain(g_all, h_all)
            if got > best + 1e-9 * UNIT:
                best, found = got, (f, b, (g, h), (g_all - g, h_all - h))
    return found


def fit(rows: DataFrame, features: int, trees: int = TREES, depth: int = DEPTH) -> Model | None:
    """Trees for rows (bins, label 0/1, weight): logistic loss, second order. None without rows of both labels.

    One aggregate for each level of a tree; what comes to the driver is at most 2 ** depth * features * BINS rows.
    """
    rows = cut(rows.select("bins", "label", "weight", F.lit(0.0).alias("from")))
    n, ones = rows.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    if not n or not 0 < ones < n:
        drop(rows)
        return None
    base = math.log(ones / (n - ones))
    model, new = Model(base, []), Model(base, [])  # new: what the written scores don't hold yet
    for _ in range(trees):
        if len(new.trees) == WRITE_EVERY:
            old, rows = rows, cut(rows.select("bins", "label", "weight", (F.col("from") + raw_score(new, F.col("bins"))).alias("from")))
            drop(old)
            new = Model(0.0, [])
        p = 1 / (1 + F.exp(-(F.col("from") + raw_score(new, F.col("bins")))))
        tree: dict[int, Split] = {}
        open_nodes = {1}
        for level in range(depth):
            at = rows.select(_node(tree, F.col("bins")).alias("node"), "bins", "label", "weight", p.alias("p")).where(F.col("node").isin(*open_nodes))
            g, h = F.round((F.col("label") - F.col("p")) * UNIT).cast("long") * F.col("weight"), F.greatest(F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long"), F.lit(1)) * F.col("weight")
            sums = at.select("node", g.alias("g"), h.alias("h"), F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            histograms: dict[int, dict] = {x: {} for x in open_nodes}
            for r in sums.collect():  # bounded by the model's parameters
                histograms[r.node][r.feature, r.bin] = (r.g, r.h)
            now = set()
            for x in sorted(open_nodes):
                s = best_split(histograms[x], features)
                if s is None:
                    one = [v for (f, _), v in histograms[x].items() if f == 0]
                    tree[x] = Split(-1, 0, _leaf(sum(v[0] for v in one), sum(v[1] for v in one)))
                else:
                    tree[x] = Split(s[0], s[1], 0.0)
                    tree[2 * x], tree[2 * x + 1] = Split(-1, 0, _leaf(*s[2])), Split(-1, 0, _leaf(*s[3]))
                    now |= {2 * x, 2 * x + 1}
            if not now:
                break
            open_nodes = now
            if level < depth - 1:
                for x in now:  # to be split, or to become leaves with the same sums
                    tree.pop(x)
        model.trees.append(tree)
        new.trees.append(tree)
    drop(rows)
    return model


def described(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> tuple[DataFrame, int]:
    """(page_id, host, path, rule, ruled, label, h, bins) as a written table, and the number of features."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    base = base.withColumn("fit", longest_rule(host, path, rules))
    plain = lexical(F.col("url"), host, path)
    label = F.when(F.col("fit.verdict").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    key = F.xxhash64(F.coalesce("url", F.lit("")))
    base = cut(
        base.select("page_id", "host", "path", F.col("fit.text").alias("rule"), F.col("fit.verdict").alias("ruled"), label.alias("label"), key.alias("h"), F.pmod(key, F.lit(FOLDS)).cast("int").alias("fold"),
                    *[v.alias(k) for k, v in plain.items()], *[v.alias(k) for k, v in suffixes(host, path).items()])
    )
    joined, more = _suffix_bins(base)
    names = [*plain, *more]
    return joined.select("page_id", "host", "path", "rule", "ruled", "label", "h", F.array(*names).alias("bins")), len(names)


def train(table: DataFrame, features: int, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Model | None:
    """Fits the trees on the labelled rows of described(): all, or about `sample` whose URL's hash lies below a bound.

    Equal rows count once with their number as weight.
    """
    labelled = table.where("label is not null")
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(F.pmod("h", F.lit(1 << 32)) < int(sample / n * (1 << 32)))
    return fit(labelled.groupBy("bins", "label").agg(F.count(F.lit(1)).alias("weight")), features, trees, depth)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, score (chance of block by the trees).

    verdict: the longest rule's; without one, block if score >= 0.5. A null URL or one without '://' has an empty host
    and path, fits no rule and is judged by the trees like any other. If the rules label no row, or all rows
    alike, there are no trees: the score is the one label's (0 without labels). Repeated rows get equal verdicts; null ids stay;
    an empty table gives an empty one; other columns, whatever their names, are ignored.
    """
    table, features = described(pages, rules, id_col, url_col)
    table = cut(table)
    model = train(table, features, sample)
    if model is None:
        blocked = table.agg(F.max("label")).first()[0] or 0
        score = F.lit(float(blocked))
    else:
        score = 1 / (1 + F.exp(-raw_score(model, F.col("bins"))))
    judged = table.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
    return judged.withColumnRenamed("page_id", id_col)
