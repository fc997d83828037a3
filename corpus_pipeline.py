"""A training corpus from raw documents: rules, near copies, repeated passages, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; every stage is written as Parquet and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.bpe import default_path
from basalt.llm.cut import drop_folder, shared_folder
from basalt.llm.neardup import near_duplicates
from basalt.llm.packing import pack
from basalt.llm.quality import quality_rules
from basalt.llm.secrets import redact
from basalt.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules reject; null, empty and wordless texts are among them. Keys decide nothing."""
    return quality_rules(docs, only_kept=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id in each group of near copies, and every document whose id is null.

    Rows of one id share its fate. Null and empty texts are copies of nothing and stay.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").dropDuplicates()
    # A join on null ids would gather them in one task; all of them are kept anyway.
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; a document left without a word goes. n_chars follows the text.

    Null and empty texts have no word and go; rows with a null id lose nothing and stay.
    """
    cut = remove_repeats(docs, layout=True).where("n_words > n_removed")
    return recount(cut, docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in each text; no row goes, and a null text stays null. n_chars follows the text."""
    return recount(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024; a null or empty text is its end id alone."""
    return pack(docs, default_path())


def recount(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", passages),
    ("secrets", secrets),
    ("packing", packing),
]
#: Sketches, automata and a linear program are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again.

    Whatever ids and texts are null, empty, long or repeated, the rows go as the
    stages say. An empty table gives no rows. Other columns pass unread.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            # What the stage before wrote is read no more: packing, the last, has cut its lineage itself.
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
