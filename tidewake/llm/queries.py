"""The registered queries: thin views of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, hmm, licenses, media, merkle, packing, pieces, secrets, simhash, toxicity, url_filter
from .common import fold, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    widest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["repositories"])), F.lit(0)).cast("long").alias("repositories")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), live, widest)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.sample(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("log_prob", "perturbed", "inclusion")]
    return found.select("doc_id", "sample", "n_pieces", *rounded, "ids_crc32", "round_trip")


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(2, 7, F.col("doc_id"))
    found = hmm.score(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = fold(0, 2, F.col("doc_id"))
    found = {"text": F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    rows = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), found=found))
    digests = [merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return rows.select("doc_id", *digests, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "verified")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secrets": op4_secrets,
    "op5_pieces": op5_pieces,
    "op6_hmm": op6_hmm,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle": op12_merkle,
    "op13_decontaminate": op13_decontaminate,
}
