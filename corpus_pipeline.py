"""From raw documents to an encoded training mix, in five stages over the whole table.

Defined results, for every stage: ids, languages, sources and lengths may be null and are
carried along; repeated rows are rows of their own, but for `distinct`; very long texts are
worked on whole; only the columns of documents go on, so extra columns end in the first
stage, whatever their names; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm._spark import shared_folder, table
from panelweave.llm.jaccard_join import least_rows
from panelweave.llm.piece_encoding import piece_digests
from panelweave.llm.queries import kept_folder, model_file
from panelweave.llm.secret_ledger import clear_stretches, current, redacted, scan
from panelweave.llm.source_mix import mix
from panelweave.llm.weak_quality import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier accepts; null texts and texts without words stay if most documents are good, as they score the share of good ones."""
    return score(docs, fit(docs), keep=COLUMNS).filter("accepted").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts: that with the least id; one with a null id only where none has an id.

    Texts of one id that do not link are different documents, and each is kept. Texts
    without words link with nothing: one row is kept for each id and text, and every row
    with a null id.
    """
    body, blank = F.coalesce(F.sha2("text", 256), F.lit("")), ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # a null id gets a stand-in of its text; it only has to lead from a row to its set
    marked = docs.withColumn("row", F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("id"), body.alias("body")))
    chosen = least_rows(marked, "row").withColumn("chosen", F.lit(True))
    nameless = F.col("doc_id").isNull() & blank
    first = marked.filter(~nameless).groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("kept"), F.first(blank).alias("blank"))
    first = first.join(chosen, "row", "left").filter("blank or chosen").select("kept.*")
    return first.unionByName(docs.filter(nameless).select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the ledger has for their blobs redacted; ids, null or repeated, play no part."""
    folder = kept_folder(spark, "pipeline-ledger", sf_dir)
    scan(docs, "doc_id", "text", folder)
    found = clear_stretches(current(spark, folder)).select(F.col("blob_id").alias("blob"), "clear")
    clean = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, "blob", "left")
    clean = clean.select("doc_id", F.when(F.col("clear").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("clear"))).alias("text"), "lang", "source", F.col("n_chars").alias("was"), "clear")
    return clean.select("doc_id", "text", "lang", "source", F.when(F.col("clear").isNull(), F.col("was")).otherwise(F.length("text").cast("bigint")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whatever its id; a part of a document counts as a whole one from its half on. Texts without words have no size, so the mix takes none of them."""
    taken = mix(docs, keep=("text", "lang", "n_chars")).filter("taken > 0").withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int"))
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids, byte spans and decoded text; a null text is an empty one."""
    return piece_digests(docs, model_file())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", distinct), ("secret scans", without_secrets), ("mixing sources", mixed), ("SentencePiece encoding", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again; of an empty table an empty result."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
