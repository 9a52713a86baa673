"""Evidence documents held against each other: traces, tasks, locks, hashes, batches and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group
from panelweave.functions.text import trimmed
from panelweave.sources.shared import written

P = "project_id"
CHUNK = 1000


def first_by_priority(pages: DataFrame, rows: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """pages with the value of the row of their project that the first of the keys (page column, row column) finds, and which key that was. A key that several rows of a project share is ambiguous."""
    found, taken = pages, []
    for rank, (own, other) in enumerate(keys):
        index = rows.filter(F.col(other).isNotNull()).groupBy(P, F.col(other).alias(own)).agg(F.min(value).alias(f"value_{rank}"), F.count("*").alias(f"count_{rank}"))
        found = found.join(index, [P, own], "left")
        taken.append(F.when(F.col(f"count_{rank}").isNotNull(), F.struct(F.lit(other).alias("by"), F.when(F.col(f"count_{rank}") == 1, F.col(f"value_{rank}")).alias("value"), (F.col(f"count_{rank}") > 1).alias("ambiguous"))))
    return found.withColumn("hit", F.coalesce(*taken)).select(*pages.columns, F.col("hit.by").alias("by"), F.col("hit.value").alias(value), F.col("hit.ambiguous").alias("ambiguous"))


def trace_differences(left: DataFrame, right: DataFrame, key: str, *fields: str) -> DataFrame:
    """key and field where two documents differ; a row that one lacks differs as `row`."""
    a = left.select(key, F.struct(*fields).alias("a"))
    b = right.select(key, F.struct(*fields).alias("b"))
    apart = F.array(*(F.when(~F.col("a")[f].eqNullSafe(F.col("b")[f]), F.lit(f)) for f in fields))
    missing = F.col("a").isNull() | F.col("b").isNull()
    return a.join(b, key, "full_outer").select(key, F.explode(F.when(missing, F.array(F.lit("row"))).otherwise(F.array_compact(apart))).alias("field"))


def not_exactly_one(units: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Units without exactly one hit, and hits of no unit, with the number of hits."""
    counted = hits.groupBy(key).agg(F.count("*").alias("n"))
    both = units.select(key).distinct().withColumn("known", F.lit(True)).join(counted, key, "full_outer")
    return both.filter("known is null or n is null or n <> 1").select(key, F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("hits"))


def lock_faults(uses: DataFrame, locks: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, page, lock_id) uses of a lock that the project does not know or that does not apply to the page. locks: project_id, lock_id; pages: project_id, lock_id, page."""
    known = locks.select(P, "lock_id").distinct().withColumn("known", F.lit(True))
    applies = pages.select(P, "lock_id", "page").distinct().withColumn("applies", F.lit(True))
    told = uses.select(P, "page", "lock_id").distinct().join(known, [P, "lock_id"], "left").join(applies, [P, "lock_id", "page"], "left")
    fault = F.when(F.col("known").isNull(), "lock_unknown").when(F.col("applies").isNull(), "lock_not_applicable")
    return told.select(P, "page", "lock_id", fault.alias("fault")).filter("fault is not null")


def hash_chain_faults(references: DataFrame, approved: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of a project whose recorded hash is not the approved one or not that of the file; each has project_id, path and sha."""
    at = [P, "path"]
    joined = references.select(*at, "sha").join(approved.select(*at, F.col("sha").alias("was_approved")), at, "left").join(files.select(*at, F.col("sha").alias("of_file")), at, "left")
    fault = F.when(F.col("of_file").isNull(), "file_missing").when(~F.col("sha").eqNullSafe(F.col("was_approved")), "approval_differs").when(F.col("sha") != F.col("of_file"), "file_differs")
    return joined.select(P, "path", fault.alias("fault")).filter("fault is not null")


def set_differences(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """Keys whose sets of members differ between two documents, whatever their order, with what each side alone has."""
    each = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(name))
    none = F.slice(F.coalesce("a", "b"), 1, 0)
    both = each(left, "a").join(each(right, "b"), key, "full_outer").select(key, F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.filter("a <> b").select(key, F.size(F.array_except("a", "b")).cast("bigint").alias("only_left"), F.size(F.array_except("b", "a")).cast("bigint").alias("only_right"))


def count_gates(pages: DataFrame, expected: DataFrame, most: int = 9_999) -> DataFrame:
    """Projects whose page count is not the expected one, or out of range. expected: project_id, n."""
    found = pages.groupBy("project_id").agg(F.count("*").alias("found"))
    joined = found.join(expected.withColumnRenamed("n", "expected"), "project_id", "full_outer").withColumn("found", F.coalesce("found", F.lit(0)))
    fault = F.when(~F.col("found").between(1, most), "count_out_of_range").when(~F.col("found").eqNullSafe(F.col("expected")), "count_differs")
    return joined.select("project_id", "found", "expected", fault.alias("fault")).filter("fault is not null")


def batch_faults(members: DataFrame, most: int = 12) -> DataFrame:
    """Rows (project_id, pos, batch, total) of recorded batches that are not where the deterministic split puts them, or that belong to a batch above the size limit."""
    sized = members.withColumn("size", F.count("*").over(Window.partitionBy("project_id", "batch")))
    want = balanced_group(F.col("pos"), F.col("total"), most)
    faults = F.array(F.when(F.col("size") > most, "size_over_limit"), F.when(~F.col("batch").eqNullSafe(want), "not_deterministic"))
    return sized.select("project_id", "pos", F.explode(F.array_compact(faults)).alias("fault"))


def early_reviews(batches: DataFrame, pages: DataFrame) -> DataFrame:
    """Batches whose review is not strictly later than each of their pages'. batches: batch, at. pages: batch, at."""
    latest = pages.groupBy("batch").agg(F.max("at").alias("latest"))
    return batches.join(latest, "batch").filter("at <= latest").select("batch")


def coverage_faults(coverage: DataFrame, locks: DataFrame, categories: tuple) -> DataFrame:
    """(project_id, category) that are not covered as they say: confirmed without a lock, not applicable with one or without a reason, or not stated.

    coverage: project_id, category, status, rationale. locks: project_id, category.
    """
    held = locks.groupBy("project_id", "category").agg(F.count("*").alias("n"))
    each = coverage.select("project_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    told = each.join(coverage, ["project_id", "category"], "left").join(held, ["project_id", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status, none = F.col("status"), F.col("n") == 0
    away = status == "not_applicable"
    fault = F.when(status.isNull(), "not_stated").when((status == "confirmed") & none, "confirmed_without_lock").when(away & ~none, "not_applicable_with_lock").when(away & trimmed(F.col("rationale")).isNull(), "rationale_missing")
    return told.select("project_id", "category", fault.alias("fault")).filter("fault is not null")


def digest_of_set(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and a digest of the distinct rows of the columns, in order: SHA-256 of the JSON list of up to CHUNK rows, else that of the list of the digests of its chunks, and so on.

    Rows are put in order by ranges, so a key of any size is spread over tasks, and what is
    hashed in one place is a chunk. A set of one chunk has the digest of its JSON list.
    """
    spelled = rows.select(F.struct(key).alias("of"), *columns).distinct()
    # a null sorts as a value of its own; the spelling of a row is in the order of its columns
    sorted_ = spelled.select("of", F.struct(*columns).alias("row")).repartitionByRange("of", "row").sortWithinPartitions("of", "row")
    placed = written(sorted_.select("of", F.to_json("row").alias("said"), F.monotonically_increasing_id().alias("at")).withColumn("run", F.shiftright("at", 33)))
    runs = placed.groupBy("of", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("of")
    ahead = F.coalesce(F.sum("n").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("of", "run", "first", ahead.alias("ahead"), F.sum("n").over(whole).alias("total"))
    level = placed.join(runs, ["of", "run"]).select("of", "said", "total", (F.col("ahead") + F.col("at") - F.col("first")).alias("pos"))
    done = None
    while True:
        chunks = level.groupBy("of", "total", F.floor(F.col("pos") / CHUNK).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("held"))  # CHUNK rows at most
        listed = F.concat(F.lit("["), F.array_join(F.transform("held", lambda x: x["said"]), ","), F.lit("]"))
        chunks = written(chunks.select("of", "pos", F.ceil(F.col("total") / CHUNK).alias("total"), F.sha2(listed, 256).alias("digest")))
        ends = chunks.filter("total = 1").select(F.col(f"of.{key}").alias(key), F.col("digest").alias("set_hash"))
        done = ends if done is None else done.unionAll(ends)
        level = chunks.filter("total > 1").select("of", F.concat(F.lit('"'), "digest", F.lit('"')).alias("said"), "total", "pos")
        if level.isEmpty():
            return done


def worst(rank: dict[str, int], column: str) -> Column:
    """Aggregate: the value of highest rank in the group."""
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    return F.max_by(column, ranks[F.col(column)])


def verdicts(projects: DataFrame, found: DataFrame) -> DataFrame:
    """project_id, violations, rules broken and ok of every project, those without violations included. found: project_id, rule_id."""
    counted = found.groupBy("project_id").agg(F.count("*").alias("violations"), F.countDistinct("rule_id").alias("rules"))
    each = projects.select("project_id").distinct()
    told = each.join(counted, each["project_id"].eqNullSafe(counted["project_id"]), "left").select(each["project_id"], *(F.coalesce(c, F.lit(0)).alias(c) for c in ("violations", "rules")))
    return told.withColumn("ok", F.col("violations") == 0)


def task_mismatches(pages: DataFrame, tasks: DataFrame, *fields: str) -> DataFrame:
    """(page, fault) of pages whose task is missing or differs from the page's trace. pages: page, task_id and fields; tasks: task_id and fields."""
    done = tasks.select("task_id", F.struct(*fields).alias("held"))
    apart = F.array(*(F.when(~F.col(f).eqNullSafe(F.col("held")[f]), F.lit(f"{f}_differs")) for f in fields))
    return pages.join(done, "task_id", "left").select("page", F.explode(F.when(F.col("held").isNull(), F.array(F.lit("task_missing"))).otherwise(F.array_compact(apart))).alias("fault"))


def batch_gate(mapping: DataFrame, reports: DataFrame) -> DataFrame:
    """(project_id, name, position, fault) where a project's ordered reports do not match its mapping by position and name. mapping: project_id, position, name. reports: project_id, position, name, report_id."""
    ids = reports.groupBy(P, "report_id").agg(F.count("*").alias("copies"))
    told = mapping.withColumnRenamed("name", "wanted").join(reports.join(ids, [P, "report_id"]), [P, "position"], "full_outer")
    fault = F.when(F.col("name").isNull(), "report_missing").when(F.col("wanted").isNull(), "report_extra").when(F.col("name") != F.col("wanted"), "name_differs").when(F.col("copies") > 1, "report_id_repeated")
    return told.select(P, F.coalesce("wanted", "name").alias("name"), "position", fault.alias("fault")).filter("fault is not null")
