"""Pages of a plan find their rows, and rows are dealt by project once."""

import pytest
from pyspark.sql import functions as F

from panelweave.functions import text
from panelweave.operators import migration_bundle as m
from panelweave.operators import migration_plan as plan

PATHS = ["in/1.jpg", "a/../b", "./a", "a//b", "a/", "/a", "C:/X", "A.png", " a", "a\n", "a/.b", "é", "a\\b", ".", "", "sheets/src1-2.png", "..", "a/..", "a/b..", None]


@pytest.fixture(scope="module")
def documents(spark):
    inputs = spark.createDataFrame([("p", i, f"{i}.png", f"in/{i}.png", "%064x" % i) for i in range(1, 6)], "project_id string, index int, input_name string, input_path string, input_sha256 string")
    # page 1 by input name (its index leads elsewhere), 2 by output name, 3 by index, 4 by a name that two rows have; 5 has no row
    rows = [("p", 0, "1.png", None, None, "a"), ("p", 1, " ", "0002.jpg", None, "b"), ("p", 2, None, None, 3, "c"), ("p", 3, "4.png", None, None, "d"), ("p", 4, "4.png", "4.png", 4, "e"), ("p", 5, None, None, 1, "f")]
    made = spark.createDataFrame(rows, "project_id string, position int, input_name string, output_name string, index int, kind string")
    alignment = made.select("project_id", "position", "input_name", "output_name", "index", F.lit("confirmed").alias("status"), F.col("kind").alias("chapter"), F.lit("l").alias("location"), F.lit("day").alias("story_time"), F.lit("s").alias("scene_id"))
    log = made.select("project_id", "position", "input_name", "output_name", "index", F.lit("").alias("page_class"), F.col("kind").alias("action"))
    return inputs, alignment, log


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_first_key_that_any_row_has_decides(documents):
    found = {r["index"]: (r.action, r.chapter, r.ambiguous, r.input_path) for r in plan.informed(*documents).collect()}
    assert found == {1: ("a", "a", False, "in/1.png"), 2: ("b", "b", False, "in/2.png"), 3: ("c", "c", False, "in/3.png"), 4: (None, "unknown", True, "in/4.png"), 5: (None, "unknown", False, "in/5.png")}


def test_pages_and_rows_are_dealt_once(documents):
    assert exchanges(plan.informed(*documents)) == 1


def test_clusters_know_the_pages_around_them(spark, documents):
    sheets = spark.createDataFrame([("p", "sheets/a.png", "%064x" % 9)], "project_id string, path string, sha256 string")
    rows, clusters, packs = plan.planned(*documents, sheets)
    first = {r["first"]: r.cluster_id for r in clusters.collect()}
    held = {r.cluster_id: [(x.path, x.role) for x in r.references] for r in packs.collect()}
    assert held[first[3]] == [(f"in/{i}.png", "primary_style" if i == 3 else "adjacent_style") for i in range(1, 6)] + [("sheets/a.png", "identity_only")]
    assert held[first[1]] == [("in/1.png", "primary_style"), ("in/2.png", "adjacent_style"), ("in/3.png", "adjacent_style"), ("sheets/a.png", "identity_only")]
    assert {r["index"]: r.cluster_id for r in rows.collect()} == first


def test_heads_are_checked_in_one_pass(spark):
    documents = spark.createDataFrame([("p", m.QA, "{}")], "project_id string, name string, body string")
    assert m.head_faults(documents)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert {(r.entity, r.fault) for r in m.head_faults(documents).collect()} == {(n, "document_missing") for n in m.NEEDED if n != m.QA} | {(m.QA, "registry_hash_differs"), (m.QA, "collection_missing")}


@pytest.mark.parametrize("lists", [[[x] for x in PATHS], [PATHS], [["a", None], None, []]])
def test_plain_paths_are_normal_as_they_are(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, paths array<string>")
    assert [r[0] for r in df.orderBy("i").select(text.normal_paths("paths")).collect()] == [None if row is None else [None if x is None else text._normal(x) for x in row] for row in lists]
