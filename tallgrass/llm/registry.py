"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projected_neighbours import nearest

    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_read(spark, sf_dir, "documents"), window=13, kept_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_classes

    return near_classes(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_read(spark, sf_dir, "documents"))


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import digests, paired_with_next

    return digests(paired_with_next(_read(spark, sf_dir, "conversations")))


def op7_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken

    return taken(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged, trusted_ids

    rows = judged(_read(spark, sf_dir, "documents"), trusted_ids(_read(spark, sf_dir, "labels")))
    return rows.select("doc_id", "quality.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import summary

    return summary(_read(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import summary

    return summary(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import summary

    return summary(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import summary

    return summary(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, manifest, preference, warc

    return {"op5_preference_formatting": preference.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op12_decontamination": decontaminate.ORACLE_SQL, "op13_merkle_manifest": manifest.ORACLE_SQL}
