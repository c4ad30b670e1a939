"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds which pairs
of blob and rule version were scanned, with their findings. Only pairs that the ledger lacks are
scanned, each distinct blob once, and findings are joined back to all rows that have the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, large, small


class Rule(NamedTuple):
    kind: str
    version: str
    pattern: str
    #: A text without this can't match; "" if there is no such part. Compared in lower case.
    needs: str = ""


#: The base rules. A run shorter than asked for can't hold a match, so lengths are in the patterns.
BASE = (
    Rule("assign", "1", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    Rule("access", "1", r"AKIA[A-Z0-9]{16,}", "akia"),
    Rule("hex", "1", r"[0-9a-f]{24,}"),
)
#: What the ledger's rules add: forms of issued tokens and key blocks.
MORE = (
    Rule("jwt", "1", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyj"),
    Rule("block", "1", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", "private key-----"),
)
FINDINGS = "array<struct<kind:string,start:int,end:int,version:string>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"
#: Rows of (id, blob) that may be broadcast.
SKIP = 500_000


def find_secrets(text: str, rules: Sequence[tuple[Rule, re.Pattern]], todo: int = -1) -> list[dict]:
    """Spans in code points, by start, then in the order of the rules; todo: bits of the rules to apply."""
    found, lower = [], None
    for k, (rule, pattern) in enumerate(rules):
        if not todo >> k & 1:
            continue
        if rule.needs:
            lower = text.lower() if lower is None else lower
            if rule.needs not in lower:
                continue
        for m in pattern.finditer(text):
            if rule.kind != "assign" or m.end(1) - m.start(1) >= 6:
                found.append((m.start(), k, m.end()))
    return [{"kind": rules[k][0].kind, "start": s, "end": e, "version": rules[k][0].version} for s, k, e in sorted(found)]


def _scan(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(r, re.compile(r.pattern)) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("version", pa.string())]))
        for batch in batches:
            found = [find_secrets(t.as_py() or "", made, todo) for t, todo in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind)], names=[*batch.schema.names[1:], "findings"])

    return run


def versioned(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def blob_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = BASE + MORE, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(findings, news): per row of versions (id_col, blob, findings, columns to keep), and the ledger's new rows.

    A ledger row is (blob, rules, findings): the rule versions that the blob was scanned with, and what
    they found. Scanned are the pairs of blob and rule version that no row of the ledger has: a changed
    rule is the only one that known blobs are scanned with again. Findings of other rules or versions
    stay in the ledger and aren't returned. ledger: of earlier runs; None for none. keep: say, path and
    version. A null text is the empty blob, without findings. Rows with the same text share a blob;
    repeated and null ids stay one row each. An empty table gives empty results. Other columns are
    ignored, whatever their names. Blobs are found by a narrow aggregate; texts are shuffled only if
    both the rows to scan and the others are too many to broadcast.
    """
    own = {versioned(r): k for k, r in enumerate(rules)}
    rows = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    named = cut(rows.select("id", F.sha2("text", 256).alias("blob"), *[f"k{i}" for i in range(len(keep))]))
    every = F.lit((1 << len(rules)) - 1)
    blobs = named.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("id")).withColumn("todo", every)
    if ledger is not None:
        bit = F.coalesce(*[F.when(F.col("rule") == v, F.lit(1 << k)) for v, k in own.items()], F.lit(0))
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.bit_or(bit).alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn("todo", F.col("todo").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0))))).drop("done")
    chosen = cut(blobs.where("todo > 0").withColumnsRenamed({"id": "cid", "blob": "cblob"}))
    here = F.col("id").eqNullSafe(F.col("cid")) & (F.col("blob") == F.col("cblob"))
    texts = rows.select("id", "text", F.sha2("text", 256).alias("blob"))
    rest = cut(named.join(large(chosen), here, "left_anti").select(F.col("id").alias("cid"), F.col("blob").alias("cblob")))
    if ledger is None and rest.count() <= SKIP:  # a chosen row is scanned once for each repeat of its id
        unseen = texts.join(F.broadcast(rest.distinct()), here, "left_anti").select("text", "blob", every.alias("todo"))
    else:
        unseen = texts.join(small(chosen, SKIP), here).select("text", "blob", "todo")
    scanned = unseen.mapInArrow(_scan(rules), f"blob string, todo int, findings {FINDINGS}")
    hits = cut(scanned.where(F.size("findings") > 0))
    told = hits.groupBy("blob").agg(F.first("findings").alias("findings"))
    news = chosen.select(F.col("cblob").alias("blob"), "todo").join(told, "blob", "left").select(
        "blob", F.filter(F.array(*[F.when(F.col("todo").bitwiseAND(F.lit(1 << k)) != 0, F.lit(v)) for v, k in own.items()]), lambda r: r.isNotNull()).alias("rules"), F.coalesce("findings", F.expr("array()").cast(FINDINGS)).alias("findings")
    )
    if ledger is not None:
        told = told.unionByName(ledger.where(F.size("findings") > 0).select("blob", "findings"))
    current = F.filter(F.array_distinct(F.flatten(F.collect_list("findings"))), lambda f: F.concat_ws(":", f["kind"], f["version"]).isin(*own))
    known = told.groupBy("blob").agg(current.alias("findings"))  # of the runs that found something in a blob
    found = named.join(known, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("findings", F.expr("array()").cast(FINDINGS)).alias("findings"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
    return found, news


def scan_into(versions: DataFrame, folder: str, **kw) -> DataFrame:
    """scan_versions() against the ledger in a shared folder, to which what is new is added; (id_col, blob, findings)."""
    spark = versions.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    there = to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to)
    found, news = scan_versions(versions, spark.read.schema(LEDGER).parquet(f"{folder}/ledger") if there else None, **kw)
    found = cut(found)  # before the ledger changes under it
    news.write.mode("append").parquet(f"{folder}/ledger")
    return found


def _redactor(mark: str):
    @F.arrow_udf("string")
    def redacted(texts: pa.Array, findings: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for r, spans in enumerate(findings.to_pylist()):
            if out[r] is not None:
                keep, upto = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                    if s["start"] >= upto:
                        keep += [out[r][upto : s["start"]], mark]
                    upto = max(upto, s["end"])
                out[r] = "".join([*keep, out[r][upto:]])
        return pa.array(out, pa.string())

    return redacted


def redact(docs: DataFrame, findings: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark, and chars_col (if there is one) brought up to date.

    findings: (blob, findings) for all blobs that have any; joined by content, so every copy is changed.
    Null texts, rows without findings and other columns stay as they are. Only texts with findings go to Python.
    """
    found = cut(findings.where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("spans_")).withColumnRenamed("blob", "blob_"))
    marked = docs.withColumn("blob_", blob_of(text_col)).join(small(found, weight=F.size("spans_") + 2), "blob_", "left")
    hit = F.when(F.size("spans_") > 0, F.col(text_col).cast("string"))
    done = marked.withColumn("redacted_", _redactor(mark)(hit, F.col("spans_")))

    def column(c: str) -> Column:
        if c == text_col:
            return F.coalesce("redacted_", F.col(f"`{c}`")).alias(c)
        own = F.col(f"`{c}`")
        return (F.when(F.col("redacted_").isNotNull(), F.length("redacted_").cast(docs.schema[c].dataType)).otherwise(own) if c == chars_col else own).alias(c)

    return done.select(*[column(c) for c in docs.columns])
