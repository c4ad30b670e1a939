"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base rules find the seed entities. Every identifier-like candidate of a text is an instance with the
words before it as lexical patterns. Patterns and instances form a graph: a pattern is as good as the
instances it precedes, an instance as good as the patterns before it, seeds being good by definition.
After some rounds the patterns of high confidence name the candidates that no base rule found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone")
#: Leftmost non-overlapping matches, written so that no pattern backtracks over a run: what a run can't
#: give at its beginning it can't give later. A card's digits are counted in the pattern.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Runs of words with a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back, n = F.reverse(number), F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """array of (text, before, start, end) of all matches: what lies between them tells where they are."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,before:string,start:int,end:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(x["m"].alias("text"), x["b"].alias("before"), s.alias("start"), e.alias("end"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pieces, start, add, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<text:string,before:string,start:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """The base rules' spans by start, then kind as listed."""
    spans = []
    for k, kind in enumerate(KINDS):
        hint = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        found = located(text, PATTERNS[kind])
        own = F.transform(F.filter(found, lambda m: valid(kind, m["text"])), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))
        none = F.array().cast("array<struct<start:int,k:int,end:int>>")
        spans.append(F.when(F.contains(text, F.lit(hint)), own).otherwise(none) if hint else own)
    return F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def plausible(kind: Column, token: Column) -> Column:
    """Whether a token may be an identifier of the kind at all: looser than the base rules."""
    n = F.length(digits(token))
    return (
        F.when(kind == "email", F.contains(token, F.lit("@")) & token.rlike("^[^@]+@[^@]+$"))
        .when(kind == "ip", token.rlike(r"^[0-9A-Fa-f]*[.:][0-9A-Fa-f.:]*[.:][0-9A-Fa-f]+$"))
        .when(kind == "card", n.between(12, 19) & token.rlike(r"^[0-9 -]+$"))
        .otherwise(n.between(7, 15) & token.rlike(r"^[+(]?[0-9][0-9 ().-]+$"))
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confidence: float = 0.5, seeds: int = 3) -> DataFrame:
    """Per row of docs: (id_col, base, spans), arrays of (kind, start, end) in code points.

    base: the base rules' spans; spans: these and the discovered ones. A pattern is one or two words
    before a candidate, lower-cased. It discovers if `seeds` different seed values of its kind follow it
    and its confidence, summed scores by different values plus one, reaches `confidence`. Null and empty
    texts have no spans. Rows are told apart by id and text; repeated rows each get the same result.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    before = lambda b: F.lower(F.rtrim(F.regexp_replace(b, r"\s+", " ")))
    # the last words before a candidate, whole; very long ones by their digest, so that a pattern stays short
    last = lambda b, n: F.substring_index(before(b), " ", -n)
    brief = lambda p: F.when(F.length(p) > 64, F.md5(p.cast("binary"))).otherwise(p)
    both = lambda b: F.when(F.contains(F.ltrim(last(b, 2)), F.lit(" ")), brief(last(b, 2))).otherwise("")
    candidates = F.transform(
        located(F.col("text"), CANDIDATE),
        lambda c: F.struct(c["text"].alias("text"), c["start"].alias("start"), c["end"].alias("end"), brief(last(c["before"], 1)).alias("one"), both(c["before"]).alias("two")),
    )
    scanned = cut(rows.select("id", F.md5(F.concat_ws("\n", F.col("id").cast("string"), F.col("id").isNull().cast("string"), F.col("text")).cast("binary")).alias("row"), base_spans(F.col("text")).alias("base"), candidates.alias("candidates")))
    # candidates without the punctuation around them, and the kind of the base span they overlap
    each = scanned.select("row", "base", F.explode("candidates").alias("c")).dropDuplicates(["row", "c"])
    lead = F.length(F.regexp_extract("c.text", r"""^[("'\[<{]*""", 0))
    value = F.regexp_replace(F.regexp_replace("c.text", r"""^[("'\[<{]+""", ""), r"""[.,;:!?)"'\]>}]+$""", "")
    overlapping = F.filter("base", lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))
    instances = cut(
        each.select("row", value.alias("value"), (F.col("c.start") + lead).alias("start"), F.element_at(F.transform(overlapping, lambda s: s["kind"]), F.when(F.size(overlapping) > 0, 1)).alias("seed"), F.array_distinct(F.array("c.one", "c.two")).alias("patterns"))
        .where("value <> ''")
    )
    edges = cut(
        instances.select("value", "seed", F.explode("patterns").alias("pattern")).where("pattern <> ''")
        .groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    )
    known = edges.where("seed is not null").groupBy("value").agg(F.max("seed").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("is_seed"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores, best = known, None
    for _ in range(rounds):
        weighed = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if("is_seed").alias("k"))
        best = cut(weighed.join(sizes, "pattern").select("pattern", "kind", "k", (F.col("s") / (F.col("n") + 1)).alias("confidence")).where(F.col("k") >= seeds))
        # an unseen value is as likely as not all of its patterns fail it
        told = (
            edges.where("seed is null").select("pattern", "value").join(best, "pattern").groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("score")).withColumn("is_seed", F.lit(False))
        )
        scores = known.unionByName(told)
    good = best.where(F.col("confidence") >= confidence).select("pattern", "kind", "confidence")
    hits = (
        instances.where("seed is null").select("row", "value", "start", F.explode("patterns").alias("pattern")).join(good, "pattern")
        .where(plausible(F.col("kind"), F.col("value")))
        .groupBy("row", "start", "value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    )
    more = hits.groupBy("row").agg(F.collect_list(F.struct("kind", "start", (F.col("start") + F.length("value")).cast("int").alias("end"))).alias("more"))  # candidates of one text
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = F.transform(F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(SPANS))), place)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select("id", "row", "base").join(more, "row", "left").select(F.col("id").alias(id_col), "base", spans.alias("spans"))
