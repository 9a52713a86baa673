"""File sources: page images, reference sheets, evidence documents, novels, reports and snapshots of many projects.

Each source lists files through Spark's own readers, so hashing and parsing run in tasks. A
project is the folder `depth` levels above a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from panelweave.functions.text import casefold
from panelweave.operators.sequence import repeated_pages, story_index

#: Image suffixes, those that pages may have, and the report's title.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff")
PAGES = ("jpg", "jpeg")
REPORT_TITLE = "# FINAL QA REPORT"


def _part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def files(spark: SparkSession, path: str, depth: int = 2, glob: str = "*") -> DataFrame:
    """project_id, path, name, suffix, sha256 of every file below path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(_part(F.col("path"), depth + 1).alias("project_id"), "path", F.url_decode(_part(F.col("path"), 1)).alias("name"), F.sha2("content", 256).alias("sha256")).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def inventory(found: DataFrame) -> DataFrame:
    """Page images in natural order with index, output name and hash."""
    pages = found.filter(F.col("suffix").isin(*PAGES)).withColumnRenamed("path", "page_id")
    return story_index(pages).select("project_id", "index", "name", "output_name", "sha256")


def repeated(found: DataFrame) -> DataFrame:
    """Page images that are one page with another of their project, whatever their extension or spelling."""
    return repeated_pages(found.filter(F.col("suffix").isin(*PAGES)).withColumnRenamed("path", "page_id")).select("project_id", "name", "copies")


def unexpected(found: DataFrame) -> DataFrame:
    """Images of a suffix that pages may not have."""
    return found.filter(F.col("suffix").isin(*IMAGES) & ~F.col("suffix").isin(*PAGES)).select("project_id", "name")


def reference_sheets(found: DataFrame) -> DataFrame:
    """Images by case-folded name, numbered in the project."""
    told = found.filter(F.col("suffix").isin(*IMAGES)).withColumn("folded", casefold("name"))
    return told.withColumn("index", F.row_number().over(Window.partitionBy("project_id").orderBy("folded", "name"))).select("project_id", "index", "name", "sha256")


def project_faults(found: DataFrame, folders: tuple) -> DataFrame:
    """project_id and fault of projects without exactly one novel or without a required folder. found: files two levels below the projects or, for novels, one."""
    inside = F.element_at(F.split("path", "/"), -2)
    told = found.groupBy("project_id").agg(F.count_if(F.col("suffix") == "txt").alias("novels"), F.collect_set(F.when(inside.isin(*folders), inside)).alias("held"))
    faults = F.concat(F.when(F.col("novels") != 1, F.array(F.lit("novel_not_one"))).otherwise(F.array().cast("array<string>")), F.transform(F.array_except(F.array(*map(F.lit, folders)), F.col("held")), lambda x: F.concat(F.lit("folder_missing:"), x)))
    return told.select("project_id", F.explode(faults).alias("fault"))


def rejected(found: DataFrame) -> DataFrame:
    """Images below page_candidates/ or with `rejected` in their path, each once."""
    path = F.lower("path")
    return found.filter(F.col("suffix").isin(*IMAGES) & (path.contains("/page_candidates/") | path.contains("rejected"))).select("project_id", "path").distinct()


def snapshot(found: DataFrame, role: str, without: str | None = None) -> DataFrame:
    """path, sha256 and role of the images, those below a folder left out."""
    kept = found.filter(F.col("suffix").isin(*IMAGES))
    if without is not None:
        kept = kept.filter(~F.col("path").contains(f"/{without}/"))
    return kept.select("path", "sha256", F.lit(role).alias("role"))


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """path, document (JSON text) and blocker: UTF-16 where a mark says so, else UTF-8 with or without one; text that is no JSON object blocks."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "content")
    head = F.hex(F.substring("content", 1, 3))
    wide = F.substring(head, 1, 4).isin("FFFE", "FEFF")
    text = F.when(wide, F.decode("content", "UTF-16")).otherwise(F.try_validate_utf8(F.regexp_replace(F.col("content").cast("string"), "^﻿", "")))
    told = raw.withColumn("document", text)
    good = F.json_object_keys("document").isNotNull() & F.try_parse_json("document").isNotNull()
    return told.select("path", F.when(good, F.col("document")).alias("document"), F.when(~F.coalesce(good, F.lit(False)), "EVIDENCE_JSON_UNREADABLE").alias("blocker"))


def document_pages(spark: SparkSession, path: str, page: StructType) -> DataFrame:
    """path, corrupt and one row for each item of pages[]; a corrupt document is one row with its text in corrupt."""
    schema = StructType([StructField("pages", ArrayType(page)), StructField("corrupt", StringType())])
    read = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(path)
    return read.select(F.input_file_name().alias("path"), "corrupt", F.posexplode_outer("pages").alias("position", "page")).select("path", "corrupt", (F.col("position") + 1).alias("position"), "page.*")


def novels(spark: SparkSession, path: str) -> DataFrame:
    """path, text and sha256 of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def reports(spark: SparkSession, path: str, keys: tuple) -> DataFrame:
    """path, values (map of key to value) and format_ok: the title leads, each other line is `key: value`, and the keys are these, once, in order."""
    lines = F.filter(F.split("value", "\r\n|\r|\n"), lambda x: F.trim(x) != "")
    told = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), lines.alias("lines")).withColumn("body", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))
    pattern = r"^([a-z_]+):\s*(.*?)\s*$"
    named = F.transform("body", lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.regexp_extract(x, pattern, 2).alias("value")))
    told = told.withColumn("named", named)
    good = F.coalesce(F.trim(F.try_element_at("lines", F.lit(1))) == REPORT_TITLE, F.lit(False)) & (F.transform("named", lambda x: x["key"]) == F.array(*map(F.lit, keys)))
    first = F.filter("named", lambda x, i: (x["key"] != "") & (F.array_position(F.transform("named", lambda y: y["key"]), x["key"]) == i + 1))
    return told.select("path", F.map_from_entries(first).alias("values"), good.alias("format_ok"))
