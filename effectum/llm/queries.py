"""The registered queries opN_<name> of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, media, packing, pii, quality, simhash, token_counts, token_store


def tokenizer(name: str) -> str:
    """The place of a file of the public tokenizers; any other path serves the operators as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.token_store(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2)
    return store.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.stored_texts(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_output_code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), size=3, radius=2, seed=42)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_documents(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their source as host."""
    return line_dedup.drop_site_lines(documents(spark, sf_dir), F.col("source")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_site_lines_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages by the host of their URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    return line_dedup.drop_site_lines(pages, F.col("host")).select("page_id", "host", "text", "n_lines", "n_dropped")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(documents(spark, sf_dir))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_token_store,
            op2_token_counts,
            op3_progressive_jpeg,
            op4_output_code_languages,
            op5_pigeonhole_simhash,
            op6_risk_controlled_quality,
            op7_chunked_bpe,
            op8_differencing_packing,
            op9_site_lines,
            op9_site_lines_of_pages,
            op10_surrogates,
        )
    }


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return {"op6_risk_controlled_quality": oracle.quality_sql(), "op9_site_lines": oracle.site_lines_sql(), "op9_site_lines_of_pages": oracle.page_lines_sql()}
