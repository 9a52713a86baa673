"""Migration bundles of many projects: evidence skeletons and proposals, reviews and report hashes, blockers and the gate, drift, and what an applied bundle is named by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group
from panelweave.functions.text import contaminated, json_hash, normal_path, trimmed, zoned_time
from panelweave.operators.migration import ACTIONS, bound_candidates
from panelweave.operators.rules import snapshot_changes

#: Fields that a report's hashes leave out.
INTEGRITY, DIGEST = ("report_integrity_hash",), ("migration_id", "report_integrity_hash", "confirmed_report_digest")
BATCH = 12
P = "project_id"


def told(c) -> Column:
    return trimmed(F.col(c) if isinstance(c, str) else c).isNotNull()


def faults(rows: DataFrame, *keys: str, **ok: Column) -> DataFrame:
    """A row (keys, fault) for each condition that a row does not meet; null does not meet one."""
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items())))
    return rows.select(*keys, F.explode(wrong).alias("fault"))


def skeletons(pages: DataFrame) -> DataFrame:
    """The first evidence of each page: its place, output name and batch, and typed nulls for what is not known yet. pages: project_id, index, input_name, input_sha256."""
    total = F.count("*").over(Window.partitionBy(P))
    batch = balanced_group(F.col("index") - 1, total, BATCH) + 1
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    return pages.select(
        P, "index", "input_name", "input_sha256", F.format_string("%04d.jpg", "index").alias("output_name"), F.format_string("batch-%03d", batch).alias("batch_id"), F.lit("inventoried").alias("state"), F.array().cast("array<string>").alias("continuity_lock_ids"), F.lit("pending").alias("page_qa"),
        F.lit("not_applicable").alias("visual_edit_mode"), F.lit(0.0).alias("changed_region_ratio"), *none("string", "output_sha256", "cluster_id", "reference_pack_id", "task_id", "generated_by", "reviewed_by"), *none("int", "start_offset", "end_offset"), *none("double", "confidence"),
    )


def proposals(skeleton: DataFrame, traces: DataFrame) -> DataFrame:
    """Skeletons with the cluster, pack, task and class that the plan traces, and the action of the class. traces: project_id, output_name, cluster_id, reference_pack_id, task_id, page_class."""
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return skeleton.drop("cluster_id", "reference_pack_id", "task_id").join(traces, [P, "output_name"]).withColumn("action", action[F.col("page_class")]).withColumn("proposal_only", F.lit(True))


def write_evidence(rows: DataFrame, path: str, force: bool = False) -> None:
    """One folder a project; existing evidence is overwritten only where that is asked for."""
    rows.write.partitionBy(P).mode("overwrite" if force else "errorifexists").parquet(path)


def id_differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, side) of ids that one document has more often than the other."""
    return left.select(*keys).exceptAll(right.select(*keys)).withColumn("side", F.lit("left")).unionAll(right.select(*keys).exceptAll(left.select(*keys)).withColumn("side", F.lit("right")))


def style_faults(packs: DataFrame, stable: DataFrame) -> DataFrame:
    """(project_id, reference_pack_id, path, fault) of primary styles that are no stable page of their project or are contaminated. packs: project_id, reference_pack_id, path, role. stable: project_id, path."""
    at = packs.filter("role = 'primary_style'").withColumn("spelled", normal_path("path"))
    known = stable.select(P, normal_path("path").alias("spelled")).distinct().withColumn("stable", F.lit(True))
    return faults(at.join(known, [P, "spelled"], "left"), P, "reference_pack_id", "path", not_stable=F.col("stable"), style_contaminated=~contaminated(F.col("spelled")))


def class_faults(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages whose class differs between manifest, repair log and task, whose action is not that of the class, or that are blocked and yet released. pages: manifest_class, repair_class, task_class, action, blocked, released."""
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    same = F.col("manifest_class") == F.col("repair_class")
    return faults(pages, *keys, page_class_differs=same, action_differs=F.col("action") == action[F.col("repair_class")], task_class_differs=F.col("task_class") == F.col("manifest_class"), blocked_page_released=~(F.col("blocked") & F.col("released")))


def sealed(body: Column) -> Column:
    """The integrity hash of a report: of all its fields but that hash."""
    return json_hash(body, *INTEGRITY)


def digest(body: Column) -> Column:
    """The confirmed digest of a report: of its fields but its hashes and its id."""
    return json_hash(body, *DIGEST)


def report_faults(reports: DataFrame, key: str) -> DataFrame:
    """(key, fault) of reports (key, body) whose recorded hashes are missing, malformed or not those of the body."""
    of = lambda field: F.get_json_object("body", f"$.{field}")
    hashed = lambda field: of(field).rlike("^[0-9a-f]{64}$")
    rows = reports.withColumn("seal", sealed(F.col("body"))).withColumn("digest", digest(F.col("body")))
    return faults(rows, key, integrity_hash_malformed=hashed("report_integrity_hash"), integrity_hash_differs=of("report_integrity_hash") == F.col("seal"), digest_malformed=hashed("confirmed_report_digest"), digest_differs=of("confirmed_report_digest") == F.col("digest"))


def reviews(reports: DataFrame) -> DataFrame:
    """Reports with reviewed_by, reviewed_at, decision and notes as review records, named by their content."""
    made = reports.select("migration_id", "confirmed_report_digest", trimmed(F.col("prepared_by")).alias("prepared_by"), trimmed(F.col("reviewed_by")).alias("reviewed_by"), "reviewed_at", F.lower(trimmed(F.col("decision"))).alias("decision"), F.coalesce("notes", F.lit("")).alias("notes"))
    return made.withColumn("review_id", review_hash())


def review_hash() -> Column:
    return F.sha2(F.to_json(F.struct("confirmed_report_digest", "decision", "migration_id", "notes", "prepared_by", "reviewed_at", "reviewed_by"), {"ignoreNullFields": "false"}), 256)


def review_faults(found: DataFrame, reports: DataFrame) -> DataFrame:
    """(migration_id, fault) of reviews that are not named by their content, not independent, not decided, not timed, or not of their report. reports: migration_id, confirmed_report_digest, prepared_by."""
    held = reports.select("migration_id", F.col("confirmed_report_digest").alias("real_digest"), F.col("prepared_by").alias("real_author"))
    rows = found.join(held, "migration_id", "left")
    alike = F.lower(trimmed(F.col("prepared_by"))) == F.lower(trimmed(F.col("reviewed_by")))
    return faults(
        rows, "migration_id", review_id_differs=F.col("review_id") == review_hash(), author_missing=told("prepared_by"), reviewer_missing=told("reviewed_by"), not_independent=~F.coalesce(alike, F.lit(False)), decision_unknown=F.col("decision").isin("accepted", "rejected"),
        time_without_zone=zoned_time(F.col("reviewed_at")).isNotNull(), digest_differs=F.col("confirmed_report_digest") == F.col("real_digest"), author_differs=F.col("prepared_by") == F.col("real_author"),
    )


def rejected_failures(candidates: DataFrame, pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(failures, blockers): rejected candidates (project_id, key, path, sha256) as observed failures of the page that their path names, and those that name none."""
    found = candidates.join(bound_candidates(candidates, pages, key), [P, key])
    seen = found.filter("page is not null").select(P, key, "page", F.lit("observed").alias("status"), F.struct("path", F.col("sha256").alias("hash")).alias("before_candidate"))
    lost = found.filter("page is null").select(P, blocker("REJECTED_EVIDENCE_UNBOUND", path=F.col("path")).alias("blocker"))
    return seen, lost


def blocker(code: str, **fields: Column) -> Column:
    """A blocker as canonical JSON: sorted fields, of which its code is one."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted({"code": F.lit(code), **fields}.items()))))


def alignment_blockers(pages: DataFrame) -> DataFrame:
    """Blockers of pages that are not confirmed, and of cluster controls at odds with their pages. pages: project_id, page, state, cluster_state, cluster_blocked."""
    open_ = (F.col("state") != "confirmed") | (F.col("cluster_state") != "confirmed")
    of_project = pages.filter(open_).groupBy(P).agg(F.array_sort(F.collect_set("page")).alias("pages")).select(P, blocker("UNCONFIRMED_ALIGNMENT_PAGES", pages=F.col("pages")).alias("blocker"))
    wrong = (F.col("cluster_state") != F.col("state")) | ((F.col("state") == "unresolved") & ~F.col("cluster_blocked"))
    return of_project.unionAll(pages.filter(wrong).select(P, blocker("CLUSTER_ALIGNMENT_CONTROL_MISMATCH", page=F.col("page")).alias("blocker")))


def gate(projects: DataFrame, blockers: list[DataFrame], bijections: DataFrame) -> DataFrame:
    """project_id, blockers (in canonical order), exact_bijection, and ready: without a blocker and exact. bijections: project_id, exact."""
    base = projects.select(P).distinct().join(bijections, P, "left").withColumn("exact_bijection", F.coalesce("exact", F.lit(False)))
    lost = base.filter("not exact_bijection").select(P, blocker("EXACT_BIJECTION_INVALID").alias("blocker"))
    held = reduce(DataFrame.unionAll, [*blockers, lost]).groupBy(P).agg(F.array_sort(F.collect_list("blocker")).alias("blockers"))
    told_ = base.join(held, P, "left").withColumn("blockers", F.coalesce("blockers", F.array().cast("array<string>")))
    return told_.select(P, "blockers", "exact_bijection", (F.col("exact_bijection") & (F.size("blockers") == 0)).alias("ready"))


def drift(planned: dict[str, DataFrame], current: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """By kind of snapshot: how many entries changed, appeared or went since the plan."""
    changes = [snapshot_changes(planned[kind], current[kind], key, value).withColumn("kind", F.lit(kind)) for kind in planned]
    return reduce(DataFrame.unionAll, changes).groupBy("kind").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))


def cache_key(prompt: str, references: str, generation: str) -> Column:
    """What makes two calls the same: the hashes of prompt, references and generation settings."""
    return F.sha2(F.to_json(F.struct(F.col(generation).alias("generation_hash"), F.col(prompt).alias("prompt_hash"), F.col(references).alias("reference_hash"))), 256)


def ocr_normal(count: str, unexpected: str, allowed: str, detected: str) -> dict[str, Column]:
    """OCR data with trimmed texts; lists of art text without repeats, in order of first appearance, absent ones empty."""
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: trimmed(x))
    return {"ordinary_text_count": F.col(count), "unexpected_texts": clean(F.col(unexpected)), "allowlisted_art_text": F.array_distinct(clean(F.col(allowed))), "detected_art_texts": F.array_distinct(clean(F.col(detected)))}


def ocr_faults(rows: DataFrame, key: str, count: str, unexpected: str, allowed: str, detected: str) -> DataFrame:
    """(key, fault) of OCR data with a missing or negative count, no list of unexpected texts, or blank texts."""
    solid = lambda c: ~F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~told(x))
    return faults(rows, key, count_invalid=F.col(count) >= 0, unexpected_missing=F.col(unexpected).isNotNull(), text_blank=solid(F.col(unexpected)) & solid(F.col(allowed)) & solid(F.col(detected)))


def guard_faults(rows: DataFrame, key: str, texts: tuple = (), lists: tuple = (), counts: tuple = (), numbers: tuple = ()) -> DataFrame:
    """(key, fault) of columns that are no text, no list of texts, no positive integer, or no finite number."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    ok = {f"{c}_no_text": told(c) for c in texts} | {f"{c}_no_list": F.col(c).isNotNull() & ~F.exists(c, lambda x: ~told(x)) for c in lists} | {f"{c}_not_positive": F.col(c) > 0 for c in counts} | {f"{c}_not_finite": finite(c) for c in numbers}
    return faults(rows, key, **ok)


def untimed(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, fault) of columns named timestamp or *_at whose text, where there is one, is no time with a zone."""
    named = [c for c in rows.columns if c == "timestamp" or c.endswith("_at")]
    return faults(rows, *keys, **{f"{c}_without_zone": F.col(c).isNull() | zoned_time(F.col(c)).isNotNull() for c in named})


def recomputed(reports: DataFrame, preflights: DataFrame, key: str) -> DataFrame:
    """(key, fault) of preflight reports (key, checks, status) that differ from the checks and status computed anew."""
    now = preflights.select(key, F.col("checks").alias("new_checks"), F.col("status").alias("new_status"))
    rows = reports.join(now, key, "left")
    names = lambda c: F.transform(c, lambda x: x["name"])
    return faults(rows, key, candidate_unknown=F.col("new_status").isNotNull(), checks_missing=F.col("new_status").isNull() | (names("checks") == names("new_checks")), check_differs=F.col("new_status").isNull() | (F.col("checks") == F.col("new_checks")), status_differs=F.col("new_status").isNull() | (F.col("status") == F.col("new_status")))
