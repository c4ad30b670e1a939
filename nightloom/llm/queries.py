"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, mix, near_duplicates, near_vectors, oracle, passages, personal_data, phrases, secrets, spelling, tokens, toxicity, url_filters, warc
from .shared import own_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_spans(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, kinds = personal_data.find_personal_data(_table(spark, sf_dir, "documents")), personal_data.KINDS
    return found.select("doc_id", *[kind_count("base", k) for k in kinds], F.sha2(joined_spans(F.col("base"), kinds), 256).alias("base_sha256"), joined_spans(F.col("spans"), kinds).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.judge(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=("doc_id",)).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_into(_table(spark, sf_dir, "documents"), own_dir(spark, "ledger"))
    kinds, base = tuple(r.kind for r in secrets.BASE + secrets.MORE), tuple(r.kind for r in secrets.BASE)
    own = F.filter("findings", lambda s: s["kind"].isin(*base))
    counts = [kind_count("findings", k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined_spans(own, base), 256).alias("base_sha256"), joined_spans(F.col("findings"), kinds).alias("spans"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_repeated", spans.alias("spans"), "other")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_near_duplicates, op3_personal_data, op4_decontaminate, op5_warc, op6_toxicity, op7_secrets, op8_passages, op9_token_counts, op10_near_vectors, op11_url_filters, op12_spelling, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": oracle.OP1, "op2_near_duplicates": oracle.OP2, "op4_decontaminate": oracle.OP4, "op5_warc": oracle.OP5, "op10_near_vectors": oracle.OP10, "op12_spelling": oracle.OP12, "op13_collocations": oracle.OP13}
