"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE  # noqa: F401  (the registry reads it here)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    found = secret_scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    line = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"), "n_linked")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


#: What op4 is asked to judge by, beside the trees.
URL_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).drop("url")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; source/lang/doc_id stands for one."""
    from .licenses import license_scan

    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan(files)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    trimmed = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return trimmed.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import top_k

    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import default_path, round_trip

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), default_path()).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import default_path
    from .packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), default_path())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bayes import quality_posterior

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return quality_posterior(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_top_k": op7_top_k,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
}
