"""Registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, langid, mixing, pieces, pii, quality, secret_scan, simhash, substring, tokens, vector_codes, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    base = F.filter("found", lambda c: c["kind"] != "guess")
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_records(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), PIECES)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n_tokens", digest("ids"), digest("decoded"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.Coder().fit_codes(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "").alias("code")
    books_hash = F.sha2(F.lit(vector_codes.listed(books)).cast("binary"), 256).alias("codebooks_sha256")
    return vector_codes.label_errors(coded).select("vec_id", code, "error", "label_error", books_hash)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii_spans, op2_simhash_near_dedup, op3_source_mix, op4_language_id, op5_secret_scan, op6_quality_rules)
    found += (op7_warc_archives, op8_substring_dedup, op9_benchmark_decontamination, op10_token_records, op11_collocations, op12_sentence_pieces, op13_vector_codes, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op3_source_mix": mixing.ORACLE, "op7_warc_archives": warc.ORACLE, "op8_substring_dedup": substring.ORACLE, "op11_collocations": collocations.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
    return out if corpus_pipeline.ORACLE_SQL is None else out | {"pipeline": corpus_pipeline.ORACLE_SQL}
