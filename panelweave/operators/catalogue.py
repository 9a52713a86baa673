"""The rule catalogue of finished projects: every rule has a number, and what breaks it is a row.

Evidence is a set of tables keyed by project_id; EVIDENCE says their columns. A group takes
the tables that it needs and returns violations (project_id, rule_id, entity, page_index).
Rules within a row are checked in one pass over its table. Across tables they are joins on
the project and a key of it, and groupings by project, so a project, which has at most 9,999
pages, is the most that one task needs together.

Values that are null, blank or of a wrong form break the rule that asks for them; a rule that
compares with a row that does not exist is broken, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.text import contaminated, json_hash, normal_path, normal_paths, trimmed, zoned_time
from panelweave.operators.rules import POLICIES

#: Names that evidence documents use, in their order.
VISUAL_CHECKS = ("original_candidate_comparison", "full_size_text", "full_size_artifacts", "reference_character_match", "novel_scene_match")
STYLE_CHECKS = (
    "unchanged_regions_preserved", "panel_geometry_preserved", "line_weight_brush_match", "color_texture_match", "face_simplification_match",
    "detail_density_match", "adjacent_comic_style_match", "character_reference_identity_only", "no_rendering_upgrade",
)
PAGE_CHECKS = (
    "novel_fidelity", "character_identity", "skin_hair_crown", "anatomy_hands_face", "clothing_props", "extra_continuity", "scene_axis_time_weather",
    "text_accuracy_speaker", "text_density_contrast_layout", "sfx", "residual_text", "artifact_damage", "style_match", "mobile_readability",
)
BATCH_CHECKS = (
    "story_order", "cross_page_character", "cross_page_extras", "cross_page_clothing_props", "cross_page_scene_axis",
    "cross_page_injuries_state", "text_sequence_speaker", "boundary_context", "page_count_order", "unresolved_issues_zero",
)
CATEGORIES = ("character", "extra", "clothing", "prop", "scene")
SOURCE_TYPES = ("novel", "reference", "adjacent_page", "established_page", "inference")
LOCK_FIELDS = ("applies_to_pages", "attribute", "category", "confidence", "confirmed", "created_at", "created_by", "lock_id", "reviewed_at", "reviewer", "source_ref", "source_type", "subject", "value")
EXTERNAL_FIELDS = ("imported_at", "imported_by", "run_dir", "source_path", "source_sha256", "status")
EVIDENCE_FILES = (
    "comic_run_manifest.json", "continuity_bible.json", "novel_alignment.json", "repair_log.json", "FINAL_QA_REPORT.md",
    "scene_clusters.json", "style_reference_packs.json", "task_queue.json", "failure_learning.json", "scene_cluster_qa.json",
)
REPORT_TITLE = "# FINAL QA REPORT"
REPORT_KEYS = ("status", "reviewer", "reviewed_at", "input_count", "output_count", "page_qa_passed", "batch_count", "batch_qa_passed", "blocking_issues", "unresolved_issues")
DONE, MODE, SCHEMA, LEGACY = "batch_qa_passed", "scene_cluster_v1", "3.0", "2.0"
BATCH, CLUSTER_LEAST, CLUSTER_MOST, RADIUS, PAGES = 12, 8, 20, 2, 9_999

_REVIEW = "status string, full_size boolean, reviewer string, reviewed_at string, checks map<string,boolean>"
_QA = "status string, pass_id string, reviewer string, reviewed_at string, checks map<string,boolean>"
_LIST = "array<string>"
EVIDENCE = {
    "projects": "project_id string, expected_count int, novel_name string, novel_sha256 string, novel_text string",
    "inputs": "project_id string, index int, input_name string, input_sha256 string",
    "outputs": "project_id string, name string, sha256 string, is_file boolean, decodable boolean",
    "files": "project_id string, path string, sha256 string",
    "headers": f"project_id string, document string, status string, expected_count int, novel_name string, novel_sha256 string, schema_version string, pipeline_mode string, evidence_files {_LIST}",
    "manifest": f"project_id string, position int, index int, input_name string, output_name string, input_sha256 string, state string, output_sha256 string, continuity_lock_ids {_LIST}, cluster_id string, reference_pack_id string, task_id string, failure_rule_ids {_LIST}, generated_by string, reviewed_by string",
    "alignment": f"project_id string, position int, index int, output_name string, status string, evidence string, novel_sha256 string, chapter string, context_excerpt string, located_by string, located_at string, scene_summary string, location string, story_time string, involved_characters {_LIST}, dialogue_owners {_LIST}, props {_LIST}, start_offset int, end_offset int, source_excerpt string, confidence double",
    "repair": f"project_id string, position int, index int, output_name string, continuity_lock_ids {_LIST}, action string, text_reset_mode string, repair_scope string, text_recognition string, text_reset_reason string, had_ordinary_text boolean, "
    "candidate_path string, candidate_sha256 string, text_snapshot_path string, text_snapshot_sha256 string, used_external boolean, external_candidate map<string,string>, "
    f"visual_review struct<{_REVIEW.replace(' ', ':').replace(',:', ',')}>, page_qa struct<{_QA.replace(' ', ':').replace(',:', ',')}>, batch_id string, cluster_id string, reference_pack_id string, task_id string, failure_rule_ids {_LIST}, generated_by string, reviewed_by string, "
    f"visual_edit_mode string, visual_issue_extent string, style_reference_pages {_LIST}, identity_reference_files {_LIST}, character_reference_role string, visual_mask_path string, visual_mask_sha256 string, changed_region_ratio double, full_page_regeneration_reason string, "
    "style_review struct<status:string,full_size:boolean,reviewer:string,reviewed_at:string,comparison_path:string,comparison_sha256:string,full_page_exception_approved:boolean,checks:map<string,boolean>>",
    "masks": "project_id string, path string, coverage double, same_size boolean",
    "bible": f"project_id string, status string, reviewer string, reviewed_at string, source_priority {_LIST}",
    "coverage": f"project_id string, category string, status string, rationale string, lock_ids {_LIST}",
    "locks": f"project_id string, position int, fields {_LIST}, lock_id string, category string, subject string, attribute string, value string, source_type string, source_ref string, applies_to_pages {_LIST}, confidence double, created_by string, created_at string, confirmed boolean, reviewer string, reviewed_at string",
    "batches": f"project_id string, position int, batch_id string, member_pages {_LIST}, context_before {_LIST}, context_after {_LIST}, batch_qa struct<{_QA.replace(' ', ':').replace(',:', ',')}>",
    "report": "project_id string, line_no int, line string",
    "clusters": f"project_id string, position int, cluster_id string, member_pages {_LIST}, undersized boolean, boundary_exception boolean, undersized_reason string, context_before {_LIST}, context_after {_LIST}, canary_page string, reference_pack_state string, reference_pack_id string",
    "tasks": "project_id string, task_id string, page_id string, state string, cluster_id string, candidate_hash string, completed_by string, prompt_reference_hash string",
    "rules": "project_id string, rule_id string",
    "packs": "project_id string, reference_pack_id string, cluster_id string, reference_binding_hash string, references array<struct<path:string,role:string,sha256:string>>",
    "stable": "project_id string, path string",
    "approved": "project_id string, path string, sha256 string",
    "cluster_qa": f"project_id string, position int, cluster_id string, member_pages {_LIST}, canary_page string, status string, pass_id string, reviewed_by string, reviewed_at string",
    "registries": "project_id string, document string, body string",
}
P = "project_id"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def told(c) -> Column:
    """The text is there and not blank."""
    return trimmed(_col(c)).isNotNull()


def timed(c) -> Column:
    return zoned_time(_col(c)).isNotNull()


def listed(c, some: bool = False) -> Column:
    """A list of texts, none of them blank; with one at least if `some`."""
    c = _col(c)
    return c.isNotNull() & ~F.exists(c, lambda x: ~told(x)) & (F.size(c) > 0 if some else F.lit(True))


def once(c) -> Column:
    return F.size(F.array_distinct(_col(c))) == F.size(_col(c))


def checked(checks: Column, names: tuple) -> Column:
    """Every named check is there and true."""
    return F.forall(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.element_at(checks, n), F.lit(False)))


def page_name(index) -> Column:
    return F.format_string("%04d.jpg", _col(index))


def page_names(first: Column, last: Column) -> Column:
    """The output names of a run of pages, none if it is empty."""
    return F.when(last >= first, F.transform(F.sequence(F.greatest(first, F.lit(1)), F.greatest(last, F.lit(1))), lambda i: F.format_string("%04d.jpg", i))).otherwise(F.array().cast(_LIST))


def broken(rows: DataFrame, entity: Column, index: Column | None = None, **ok: Column) -> DataFrame:
    """A violation for each rule whose condition a row does not meet."""
    faults = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(rule)) for rule, good in ok.items())))
    return rows.select(P, F.explode(faults).alias("rule_id"), entity.cast("string").alias("entity"), (F.lit(None) if index is None else index).cast("int").alias("page_index"))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, found)


def repeats(rows: DataFrame, *keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) == 1


def output_rules(projects: DataFrame, outputs: DataFrame) -> DataFrame:
    """As many output pages as expected, named without a gap, nothing else beside them, and all readable."""
    page = F.col("is_file") & F.lower("name").rlike(r"\.jpe?g$")
    seen = outputs.withColumn("page", page).withColumn("number", F.expr("try_cast(nullif(regexp_extract(name, '^([0-9]{4})[.]jpg$', 1), '') as int)")).join(projects.select(P, "expected_count"), P)
    fits = F.col("number").between(1, F.col("expected_count")) & F.col("is_file")
    counts = seen.groupBy(P).agg(F.count_if(F.col("page")).alias("pages"), F.count_if(fits).alias("fitting"), F.countDistinct(F.when(fits, F.col("number"))).alias("names"), F.count("*").alias("entries"))
    told_ = projects.select(P, "expected_count").join(counts, P, "left").na.fill(0)
    whole = (F.col("names") == F.col("expected_count")) & (F.col("pages") == F.col("expected_count"))
    of_project = broken(told_, F.col(P), None, V01=F.col("pages") == F.col("expected_count"), V02=whole & (F.col("fitting") == F.col("pages")), V03=whole & (F.col("entries") == F.col("expected_count")))
    return union(of_project, broken(seen.filter("page"), F.col("name"), F.col("number"), V04=F.col("decodable")))


def count_rules(projects: DataFrame, manifest: DataFrame, alignment: DataFrame, repair: DataFrame) -> DataFrame:
    """Each document has as many page rows as are expected."""
    found = []
    for name, rows in (("manifest", manifest), ("novel alignment", alignment), ("repair log", repair)):
        each = projects.select(P, "expected_count").join(rows.groupBy(P).agg(F.count("*").alias("found")), P, "left")
        found.append(broken(each, F.lit(name), None, V05=F.coalesce("found", F.lit(0)) == F.col("expected_count")))
    return union(*found)


def header_rules(projects: DataFrame, headers: DataFrame) -> DataFrame:
    """States of the run, the alignment and the repair log, the expected count and the novel of the run."""
    both = headers.select(P, "document", "status", F.col("expected_count").alias("said_count"), F.col("novel_name").alias("said_name"), F.col("novel_sha256").alias("said_sha")).join(projects, P)
    name = lambda d: both.filter(F.col("document") == d)
    run = broken(name("manifest"), F.lit("manifest"), None, V06=F.col("status") == DONE, V07=F.col("said_count") == F.col("expected_count"), V08=(F.col("said_name") == F.col("novel_name")) & (F.col("said_sha") == F.col("novel_sha256")))
    return union(run, broken(name("alignment"), F.lit("alignment"), None, V09=F.col("status") == "confirmed"), broken(name("repair"), F.lit("repair"), None, V09=F.col("status") == DONE))


def manifest_rules(inputs: DataFrame, manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each manifest row maps its input to its output, and names the hashes of both."""
    real = inputs.select(P, F.col("index").alias("position"), F.col("input_name").alias("real_name"), F.col("input_sha256").alias("real_sha"))
    made = outputs.filter("is_file").groupBy(P, F.col("name").alias("wanted")).agg(F.first("sha256").alias("made_sha"))
    rows = manifest.withColumn("wanted", page_name("position")).join(real, [P, "position"]).join(made, [P, "wanted"], "left")
    done = F.col("state") == DONE
    return broken(
        rows, F.col("wanted"), F.col("position"), V10=(F.col("index") == F.col("position")) & (F.col("output_name") == F.col("wanted")), V11=(F.col("input_name") == F.col("real_name")) & (F.col("input_sha256") == F.col("real_sha")),
        V12=done, V13=~F.coalesce(done, F.lit(False)) | (told("output_sha256") & F.coalesce(F.col("output_sha256") == F.col("made_sha"), F.lit(False))),
    )


def lock_reference_rules(manifest: DataFrame, repair: DataFrame, locks: DataFrame) -> DataFrame:
    """Locks that the manifest and the repair log name are there, apply to the page, and are the same in both."""
    known = locks.filter(told("lock_id")).groupBy(P, "lock_id").agg(F.min_by("applies_to_pages", "position").alias("applies"))
    named = lambda rows: rows.select(P, "position", page_name("position").alias("name"), F.explode("continuity_lock_ids").alias("lock_id")).join(known.withColumn("there", F.lit(True)), [P, "lock_id"], "left")
    applies = F.array_contains("applies", F.col("name"))
    run = broken(manifest, page_name("position"), F.col("position"), V14=listed("continuity_lock_ids", True))
    good = manifest.filter(listed("continuity_lock_ids", True))
    uses = broken(named(good), F.col("lock_id"), F.col("position"), V15=F.col("there"), V16=F.col("there").isNull() | applies)
    own = repair.withColumn("fine", listed("continuity_lock_ids", True) & once("continuity_lock_ids"))
    mapped = broken(own, page_name("position"), F.col("position"), V25=(F.col("index") == F.col("position")) & (F.col("output_name") == page_name("position")), V26=F.col("fine"))
    repaired = broken(named(own.filter("fine")), F.col("lock_id"), F.col("position"), V26=F.col("there") & applies)
    sets = repair.select(P, "position", F.col("continuity_lock_ids").alias("a")).join(manifest.select(P, "position", F.col("continuity_lock_ids").alias("b")), [P, "position"], "left")
    same = broken(sets, page_name("position"), F.col("position"), V27=F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b")))
    return union(run, uses, mapped, repaired, same)


def alignment_rules(projects: DataFrame, alignment: DataFrame) -> DataFrame:
    """A page's place in the novel is confirmed with evidence, and its excerpt is the slice that its offsets name."""
    rows = alignment.join(projects.select(P, F.col("novel_sha256").alias("real_sha"), "novel_text"), P).withColumn("wanted", page_name("position"))
    sure = F.coalesce((F.col("status") == "confirmed") & told("evidence"), F.lit(False))
    placed = F.coalesce((F.col("start_offset") >= 0) & (F.col("start_offset") < F.col("end_offset")) & (F.col("end_offset") <= F.length("novel_text")), F.lit(False))
    said = [told(c) for c in ("chapter", "context_excerpt", "located_by", "located_at", "scene_summary", "location", "story_time")]
    slice_ = F.substring(F.col("novel_text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    base = broken(rows, F.col("wanted"), F.col("position"), V17=(F.col("index") == F.col("position")) & (F.col("output_name") == F.col("wanted")), V18=sure)
    more = broken(
        rows.filter(sure), F.col("wanted"), F.col("position"), V19=F.col("novel_sha256") == F.col("real_sha"), V20=reduce(Column.__and__, said),
        V21=listed("involved_characters", True) & listed("dialogue_owners") & listed("props"), V22=placed, V23=~placed | F.col("source_excerpt").eqNullSafe(slice_), V24=F.col("confidence").between(0, 1),
    )
    return union(base, more)


def policy_rules(repair: DataFrame) -> DataFrame:
    """Values of a repair row are known, and their combination is legal."""
    fields = ("action", "repair_scope", "text_recognition", "text_reset_mode", "text_reset_reason")
    values = {name: sorted({p[i] for p in POLICIES}) for name, i in zip(fields, (0, 1, 3, 4, 5))}
    spelled = lambda had: F.concat_ws("/", "action", "repair_scope", had, "text_recognition", "text_reset_mode", "text_reset_reason")
    legal = ["/".join(p) for p in POLICIES]
    is_legal = F.col("had_ordinary_text").isNotNull() & (spelled(F.col("had_ordinary_text").cast("string")).isin(*legal) | spelled(F.lit("any")).isin(*legal))
    of = lambda c: F.col(c).isin(*values[c])
    return broken(repair, page_name("position"), F.col("position"), V28=of("action"), V29=of("text_reset_mode"), V30=of("repair_scope"), V31=of("text_recognition"), V32=of("text_reset_reason"), V33=is_legal)


def safe(path: Column) -> Column:
    """A path below the project: relative, with no step that climbs out of it."""
    steps = F.split(F.translate(path, "\\", "/"), "/")
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(0)).alias("low")))
    return ~path.rlike(r"^([A-Za-z]:|[\\/])") & (depth["low"] >= 0)


def file_rules(rows: DataFrame, files: DataFrame, path: Column, digest: Column, rules: tuple[str, str, str]) -> DataFrame:
    """For each row: a path is given and safe, its file is there, and the recorded hash is the file's."""
    at = rows.select(P, "position", path.alias("path"), digest.alias("digest")).withColumn("safe", F.coalesce(told("path") & safe(F.col("path")), F.lit(False)))
    held = files.groupBy(P, "path").agg(F.first("sha256").alias("real"))
    both = at.join(held, [P, "path"], "left")
    there = F.col("real").isNotNull()
    a, b, c = rules
    return broken(both, F.coalesce("path", F.lit("")), F.col("position"), **{a: F.col("safe"), b: ~F.col("safe") | there, c: ~F.col("safe") | ~there | F.coalesce(F.col("digest") == F.col("real"), F.lit(False))})


def snapshot_rules(repair: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates and text snapshots are safe paths of files with the recorded hashes."""
    return union(*(file_rules(repair, files, F.col(f"{k}_path"), F.col(f"{k}_sha256"), ("V34", "V35", "V36")) for k in ("candidate", "text_snapshot")))


#: where external candidates come from, and how the folder of a run is named there; a site may have others
EXTERNAL_RUNS = ("D:/runs/", r"[a-z][a-z-]*_[0-9]{8}_[0-9]{6}")


def external_rules(repair: DataFrame, files: DataFrame, runs: tuple[str, str] = EXTERNAL_RUNS) -> DataFrame:
    """An external candidate is null where none was used; else it has its six fields, lies in a run folder of the right name, and its hash chain holds. runs: the fixed place of such folders and the pattern of their names, which the caller gives."""
    c = F.col("external_candidate")
    of = lambda name: F.element_at(c, name)
    root, name = runs
    spelled = F.translate(of("run_dir"), "\\", "/")
    inside = F.startswith(F.translate(of("source_path"), "\\", "/"), F.concat(spelled, F.lit("/final/"))) & ~F.translate(of("source_path"), "\\", "/").contains("/../")
    held = files.groupBy(P, F.col("path").alias("external_path")).agg(F.first("sha256").alias("real"))
    rows = repair.withColumn("external_path", of("source_path")).join(held, [P, "external_path"], "left")
    whole = (F.array_sort(F.map_keys(c)) == F.array(*map(F.lit, EXTERNAL_FIELDS))) & F.startswith(spelled, F.lit(root)) & F.substring(spelled, F.lit(len(root) + 1), F.length(spelled)).rlike(f"^{name}$") & inside
    chain = (of("source_sha256") == F.col("real")) & (F.col("candidate_sha256") == F.col("real")) & (of("status") == "supervised_import") & told(of("imported_by")) & timed(of("imported_at"))
    return broken(rows, page_name("position"), F.col("position"), V37=F.when(~F.col("used_external"), c.isNull()).when(F.col("used_external"), whole & chain))


def page_review_rules(repair: DataFrame, batches: DataFrame) -> DataFrame:
    """The visual review and the page QA of each page passed, by someone, at a time, with every check true; pass ids are used once."""
    v, q = (lambda f: F.col(f"visual_review.{f}")), (lambda f: F.col(f"page_qa.{f}"))
    pages = repair.select(P, "position", q("pass_id").alias("pass_id")).unionAll(batches.select(P, "position", F.col("batch_qa.pass_id")))
    uses = pages.filter(told("pass_id")).groupBy(P, "pass_id").agg(F.count("*").alias("uses"))
    rows = repair.withColumn("pass_id", q("pass_id")).join(uses, [P, "pass_id"], "left")
    return broken(
        rows, page_name("position"), F.col("position"), V38=(v("status") == "passed") & v("full_size"), V39=told(v("reviewer")), V40=timed(v("reviewed_at")), V41=checked(v("checks"), VISUAL_CHECKS),
        V42=(q("status") == "passed") & told(q("pass_id")), V43=F.coalesce("uses", F.lit(0)) <= 1, V44=told(q("reviewer")), V45=timed(q("reviewed_at")), V46=checked(q("checks"), PAGE_CHECKS),
    )


def _runs(rows: DataFrame) -> DataFrame:
    """Adds size and cursor (how many members the groups before have), and expected members and context of each group."""
    size = F.size(F.coalesce("member_pages", F.array().cast(_LIST)))
    ahead = Window.partitionBy(P).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("size", size).withColumn("cursor", F.coalesce(F.sum("size").over(ahead), F.lit(0)).cast("int"))
    last = F.col("cursor") + F.col("size")
    total = F.col("expected_count")
    part = lambda a, b: page_names(F.greatest(a, F.lit(1)), F.least(b, total))
    return sized.withColumn("expected", part(F.col("cursor") + 1, last)).withColumn("before", part(F.col("cursor") - RADIUS + 1, F.least(F.col("cursor"), total))).withColumn("after", part(last + 1, last + RADIUS))


def batch_rules(projects: DataFrame, batches: DataFrame, repair: DataFrame) -> DataFrame:
    """Batches are the deterministic split in story order with exact context, each page is in one, and each was reviewed after its pages."""
    known = projects.select(P, "expected_count")
    counts = known.join(batches.groupBy(P).agg(F.count("*").alias("found")), P, "left")
    number = broken(counts, F.col(P), None, V47=F.coalesce("found", F.lit(0)) == F.ceil(F.col("expected_count") / BATCH))
    rows = _runs(batches.join(known, P)).withColumn("alone", repeats(batches, P, "batch_id"))
    k = F.ceil(F.col("expected_count") / BATCH)
    right = F.floor(F.col("expected_count") / k) + F.when(F.col("position") <= F.col("expected_count") % k, 1).otherwise(0)
    q = lambda f: F.col(f"batch_qa.{f}")
    members = rows.select(P, "position", "batch_id", F.explode("member_pages").alias("output_name"))
    times = repair.select(P, page_name("position").alias("output_name"), F.col("batch_id").alias("said_batch"), zoned_time(F.col("page_qa.reviewed_at")).alias("at"))
    latest = members.join(times, [P, "output_name"], "left").groupBy(P, "position").agg(F.max("at").alias("latest"), F.count_if(F.col("at").isNull()).alias("untimed"))
    rows = rows.join(latest, [P, "position"], "left")
    own = zoned_time(q("reviewed_at"))
    each = broken(
        rows, F.col("batch_id"), None, V48=told("batch_id") & F.col("alone"), V49=F.col("size").between(1, BATCH) & ((F.col("position") > k) | (F.col("size") == right)), V50=listed("member_pages", True) & (F.col("member_pages") == F.col("expected")),
        V51=(F.col("context_before") == F.col("before")) & (F.col("context_after") == F.col("after")), V53=(q("status") == "passed") & told(q("pass_id")) & told(q("reviewer")) & own.isNotNull() & checked(q("checks"), BATCH_CHECKS),
        V54=own.isNull() | F.coalesce(F.col("untimed") > 0, F.lit(True)) | (own > F.col("latest")),
    )
    of_page = members.groupBy(P, "output_name").agg(F.count("*").alias("uses"), F.max_by("batch_id", "position").alias("batch_id"))
    pages = projects.select(P, F.explode(page_names(F.lit(1), F.col("expected_count"))).alias("output_name")).join(of_page, [P, "output_name"], "left").join(times, [P, "output_name"], "left")
    index = F.substring("output_name", 1, 4).cast("int")
    return union(number, each, broken(pages, F.col("output_name"), index, V52=F.col("uses") == 1, V55=F.col("said_batch").eqNullSafe(F.col("batch_id"))))


def report_values(report: DataFrame) -> DataFrame:
    """project_id, well_formed, and the values by key of each final report: a title, and ten `key: value` lines in their order."""
    text = F.regexp_replace("line", r"(?U)\s+$", "")
    lines = report.filter(told("line")).withColumn("n", F.row_number().over(Window.partitionBy(P).orderBy("line_no"))).withColumn("key", F.regexp_extract(text, r"^([a-z_]+):\s*(.*)$", 1)).withColumn("value", F.regexp_extract(text, r"^([a-z_]+):\s*(.*)$", 2))
    title = F.max((F.col("n") == 1) & (trimmed(F.col("line")) == REPORT_TITLE))
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "key")))), lambda x: x["key"])
    values = F.map_from_entries(F.array_sort(F.collect_set(F.when((F.col("n") > 1) & F.col("key").isin(*REPORT_KEYS), F.struct("key", "value")))))
    made = lines.withColumn("value", F.last("value").over(Window.partitionBy(P, "key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return made.groupBy(P).agg(title.alias("title"), keys.alias("keys"), values.alias("held")).select(P, (F.col("title") & (F.col("keys") == F.array(*map(F.lit, REPORT_KEYS)))).alias("well_formed"), "held")


def report_rules(projects: DataFrame, inputs: DataFrame, outputs: DataFrame, report: DataFrame) -> DataFrame:
    """The final report has its form, passed by someone at a time, and its seven counters are the counted ones."""
    n_in = inputs.groupBy(P).agg(F.count("*").alias("n_in"))
    n_out = outputs.filter(F.col("is_file") & F.lower("name").rlike(r"\.jpe?g$")).groupBy(P).agg(F.count("*").alias("n_out"))
    rows = projects.select(P, "expected_count").join(n_in, P, "left").join(n_out, P, "left").na.fill(0, ["n_in", "n_out"]).join(report_values(report), P, "left")
    of = lambda k: F.element_at("held", F.lit(k))
    batches = F.ceil(F.col("expected_count") / BATCH)
    wanted = dict(zip(REPORT_KEYS[3:], (F.col("n_in"), F.col("n_out"), F.col("expected_count"), batches, batches, F.lit(0), F.lit(0))))
    head = broken(rows, F.col(P), None, V56=F.col("well_formed"), V57=(of("status") == "passed") & told(of("reviewer")) & timed(of("reviewed_at")))
    number = lambda k: F.expr(f"try_cast(trim(element_at(held, '{k}')) as bigint)")
    return union(head, *(broken(rows, F.lit(k), None, V58=number(k) == want) for k, want in wanted.items()))


def bible_rules(projects: DataFrame, bible: DataFrame, coverage: DataFrame, locks: DataFrame) -> DataFrame:
    """The continuity header is confirmed, each lock is whole, and each category is covered as it says."""
    rows = projects.select(P, "expected_count").join(bible, P)
    head = broken(rows, F.col(P), None, V59=F.col("status") == "confirmed", V60=told("reviewer"), V61=timed("reviewed_at"), V62=F.col("source_priority") == F.array(*map(F.lit, SOURCE_TYPES)))
    lists = broken(rows.join(coverage.select(P).distinct().withColumn("covered", F.lit(True)), P, "left").join(locks.select(P).distinct().withColumn("locked", F.lit(True)), P, "left"), F.col(P), None, V63=F.col("covered") & F.col("locked"))
    held = locks.join(projects.select(P, "expected_count"), P).withColumn("first", F.row_number().over(Window.partitionBy(P, "lock_id").orderBy("position")) == 1)
    known = F.forall("applies_to_pages", lambda x: x.rlike(r"^[0-9]{4}\.jpg$") & F.substring(x, 1, 4).try_cast("int").between(1, F.col("expected_count")))
    each = broken(
        held, F.coalesce("lock_id", F.col("position").cast("string")), None, V64=F.array_sort("fields") == F.array(*map(F.lit, LOCK_FIELDS)), V65=told("lock_id") & F.col("first"),
        V66=F.col("category").isin(*CATEGORIES) & told("subject") & told("attribute") & told("value") & told("source_ref") & told("created_by") & F.col("source_type").isin(*SOURCE_TYPES),
        V67=F.col("confirmed") & told("reviewer") & timed("reviewed_at"), V68=listed("applies_to_pages", True) & known, V69=F.col("confidence").between(0, 1) & timed("created_at"),
    )
    stated = projects.select(P, F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category")).join(coverage, [P, "category"], "left")
    of_lock = locks.filter(told("lock_id")).groupBy(P, "lock_id").agg(F.min_by("category", "position").alias("of"))
    used = stated.filter("status = 'confirmed'").select(P, "category", F.explode("lock_ids").alias("lock_id")).join(of_lock, [P, "lock_id"], "left").groupBy(P, "category").agg(F.count_if(~F.col("of").eqNullSafe(F.col("category"))).alias("wrong"))
    any_lock = locks.select(P, "category").distinct().withColumn("some", F.lit(True))
    rows = stated.join(used, [P, "category"], "left").join(any_lock, [P, "category"], "left")
    sure, away = F.coalesce(F.col("status") == "confirmed", F.lit(False)), F.coalesce(F.col("status") == "not_applicable", F.lit(False))
    covered = broken(
        rows, F.col("category"), None, V70=sure | away, V71=~sure | (listed("lock_ids", True) & once("lock_ids") & (F.coalesce("wrong", F.lit(0)) == 0) & F.coalesce("some", F.lit(False))),
        V72=~away | ((F.size("lock_ids") == 0) & told("rationale")),
    )
    return union(head, lists, each, covered)


def style_rules(projects: DataFrame, repair: DataFrame, files: DataFrame, masks: DataFrame) -> DataFrame:
    """Pages without visual repair have the neutral style contract; visual ones name their mode, references near them, mask and review."""
    s = lambda f: F.col(f"style_review.{f}")
    none = lambda *cs: reduce(Column.__and__, [_col(c).isNull() for c in cs])
    rows = repair.join(projects.select(P, "expected_count"), P)
    quiet = (s("status") == "not_applicable") & (~s("full_size")) & none(s("reviewer"), s("reviewed_at"), s("comparison_path"), s("comparison_sha256")) & (~s("full_page_exception_approved"))
    unchecked = F.forall(F.array(*map(F.lit, STYLE_CHECKS)), lambda n: F.coalesce(~F.element_at(s("checks"), n), F.lit(False)))
    neutral = (F.col("visual_edit_mode") == "not_applicable") & (F.col("visual_issue_extent") == "not_applicable") & (F.size("style_reference_pages") == 0) & (F.size("identity_reference_files") == 0) & (F.col("character_reference_role") == "not_applicable")
    neutral = neutral & none("visual_mask_path", "visual_mask_sha256", "full_page_regeneration_reason") & (F.col("changed_region_ratio") == 0) & quiet & unchecked
    plain = broken(rows.filter(F.col("repair_scope").isin("unchanged", "text_only")), page_name("position"), F.col("position"), V73=neutral)
    seen = rows.filter("repair_scope = 'visual'")
    number = lambda x: F.when(x.rlike(r"^[0-9]{4}\.jpg$"), F.substring(x, 1, 4).try_cast("int"))
    refs = F.col("style_reference_pages")
    known = listed(refs, True) & once(refs) & F.forall(refs, lambda x: F.coalesce(number(x).between(1, F.col("expected_count")), F.lit(False)))
    near = F.exists(refs, lambda x: F.abs(number(x) - F.col("position")).between(1, RADIUS))
    sheets = F.col("identity_reference_files")
    fine = listed(sheets) & once(sheets) & F.when(F.size(sheets) > 0, F.col("character_reference_role") == "identity_only").otherwise(F.col("character_reference_role") == "not_applicable")
    mask = masks.groupBy(P, F.col("path").alias("visual_mask_path")).agg(F.first("coverage").alias("measured"), F.first("same_size").alias("same_size"))
    seen = seen.join(mask, [P, "visual_mask_path"], "left")
    part, full, ratio = F.col("visual_edit_mode").isin("localized_inpaint", "localized_regeneration"), F.col("visual_edit_mode") == "full_page_regeneration", F.col("changed_region_ratio")
    covers = F.coalesce(F.col("measured") == 1, F.lit(False))
    local = (F.col("visual_issue_extent") == "localized") & F.col("full_page_regeneration_reason").isNull() & ~covers & ~s("full_page_exception_approved")
    page_wide = (F.col("visual_issue_extent") == "page_wide") & told("full_page_regeneration_reason") & (ratio == 1) & covers & s("full_page_exception_approved")
    each = broken(
        seen, page_name("position"), F.col("position"), V74=part | full, V75=F.col("visual_issue_extent").isin("localized", "page_wide"), V76=known, V77=~F.coalesce(known, F.lit(False)) | (F.col("expected_count") <= 1) | near, V78=fine, V80=(ratio > 0) & (ratio <= 1),
        V81=F.col("measured").isNull() | (F.col("same_size") & (F.abs(F.col("measured") - ratio) <= 0.01)), V82=(s("status") == "passed") & s("full_size") & told(s("reviewer")) & timed(s("reviewed_at")), V83=checked(s("checks"), STYLE_CHECKS),
        V85=F.when(part, local).when(full, page_wide).otherwise(F.lit(True)),
    )
    identity = seen.select(P, "position", F.explode("identity_reference_files").alias("sheet"))
    there = files.select(P, "path").distinct().withColumn("there", F.lit(True))
    identity = identity.withColumn("path", F.concat(F.lit("人物参考图/"), F.col("sheet"))).join(there, [P, "path"], "left")
    sheet = broken(identity, F.col("sheet"), F.col("position"), V78=safe(F.col("sheet")) & F.col("there"))
    hashes = lambda path, digest, rule: file_rules(seen, files, path, digest, ("a", "b", "c")).withColumn("rule_id", F.lit(rule))
    return union(plain, each, sheet, hashes(F.col("visual_mask_path"), F.col("visual_mask_sha256"), "V79"), hashes(s("comparison_path"), s("comparison_sha256"), "V84"))


def schema_rules(headers: DataFrame, manifest: DataFrame, repair: DataFrame, inputs: DataFrame, projects: DataFrame) -> DataFrame:
    """Both documents have one known schema and mode, legacy ones none of the new fields, new ones the whole evidence set and a strict bijection."""
    side = lambda d, x: headers.filter(F.col("document") == d).select(P, *(F.col(c).alias(f"{x}_{c}") for c in ("schema_version", "pipeline_mode", "evidence_files")))
    fresh = ("cluster_id", "reference_pack_id", "task_id", "failure_rule_ids", "generated_by", "reviewed_by")
    uses = union(*(d.select(P, reduce(Column.__or__, [F.col(c).isNotNull() for c in fresh]).alias("fresh")) for d in (manifest, repair))).groupBy(P).agg(F.max("fresh").alias("fresh"))
    rows = side("manifest", "a").join(side("repair", "b"), P, "full_outer").join(uses, P, "left")
    same = F.col("a_schema_version").eqNullSafe(F.col("b_schema_version"))
    legacy, new = same & F.coalesce(F.col("a_schema_version") == LEGACY, F.lit(False)), same & F.coalesce(F.col("a_schema_version") == SCHEMA, F.lit(False))
    moded = (F.col("a_pipeline_mode") == MODE) & (F.col("b_pipeline_mode") == MODE)
    bare = F.col("a_pipeline_mode").isNull() & F.col("b_pipeline_mode").isNull() & F.col("a_evidence_files").isNull() & F.col("b_evidence_files").isNull() & ~F.coalesce("fresh", F.lit(False))
    whole = F.array(*map(F.lit, EVIDENCE_FILES))
    declared = (F.col("a_evidence_files") == whole) & (F.col("b_evidence_files") == whole)
    head = broken(rows, F.col(P), None, V86=legacy | new, V87=~new | moded, V88=F.when(legacy, bare).when(new & F.coalesce(moded, F.lit(False)), declared).otherwise(F.lit(True)))
    strict = rows.filter(new & moded).select(P)
    real = inputs.select(P, F.col("index").alias("position"), F.col("input_name").alias("real"))
    one = projects.select(P, F.explode(F.sequence(F.lit(1), F.col("expected_count"))).alias("position")).join(real, [P, "position"], "left")
    a = manifest.select(P, "position", F.col("input_name").alias("a_in"), F.col("output_name").alias("a_out"))
    b = repair.select(P, "position", F.col("output_name").alias("b_out"))
    pages = one.join(a, [P, "position"], "full_outer").join(b, [P, "position"], "full_outer")
    wanted = page_name("position")
    ok = F.coalesce((F.col("a_in") == F.col("real")) & (F.col("a_out") == wanted) & (F.col("b_out") == wanted), F.lit(False))
    names = pages.withColumn("ok", ok).groupBy(P).agg(F.min("ok").alias("ok"))
    return union(head, broken(names.join(strict, P), F.col(P), None, V89=F.col("ok")))


def cluster_rules(projects: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters are named once, of legal size, in story order with exact context, with a canary of their own and a bound pack, and cover all pages."""
    known = projects.select(P, "expected_count")
    rows = clusters.join(known, P).withColumn("first", F.row_number().over(Window.partitionBy(P, "cluster_id").orderBy("position")) == 1)
    named = told("cluster_id") & F.col("first")
    first = rows.filter(named)
    # a cluster whose members are no list takes no place in the story
    listed_ = listed("member_pages", True) & once("member_pages")
    runs = _runs(first.filter(listed_))
    whole = page_names(F.lit(1), F.col("expected_count"))
    size, small = F.col("size"), F.col("undersized")
    boundary = F.col("boundary_exception") & (F.col("expected_count") < CLUSTER_LEAST) & (F.col("member_pages") == whole) & (F.col("undersized_reason") == "project_total_below_min")
    each = broken(
        runs, F.col("cluster_id"), None, V92=small.isNotNull() & (size <= CLUSTER_MOST) & (small == (size < CLUSTER_LEAST)), V93=F.coalesce(~small, F.lit(True)) | F.coalesce(boundary, F.lit(False)), V94=F.col("member_pages") == F.col("expected"),
        V95=(F.col("context_before") == F.col("before")) & (F.col("context_after") == F.col("after")), V96=F.array_contains("member_pages", F.col("canary_page")), V97=(F.col("reference_pack_state") == "bound") & told("reference_pack_id"),
    )
    ordered = runs.groupBy(P).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "member_pages"))), lambda x: x["member_pages"])).alias("all"))
    covered = broken(known.join(ordered, P, "left"), F.col(P), None, V98=F.col("all") == whole)
    return union(broken(rows, F.coalesce("cluster_id", F.col("position").cast("string")), None, V90=named), broken(first, F.col("cluster_id"), None, V91=listed_), each, covered)


def task_rules(projects: DataFrame, manifest: DataFrame, repair: DataFrame, tasks: DataFrame, task_faults: DataFrame) -> DataFrame:
    """V99-V102: tasks are named once and completed, the queue is valid (task_faults: project_id, entity, as task_rules.queue_faults finds them), and there is exactly one for each page, the one that manifest and repair log name."""
    rows = tasks.withColumn("alone", repeats(tasks, P, "task_id"))
    each = broken(rows, F.col("task_id"), None, V99=told("task_id") & F.col("alone"), V100=F.col("state") == "completed")
    queue = task_faults.select(P, F.lit("V101").alias("rule_id"), F.col("entity").cast("string").alias("entity"), F.lit(None).cast("int").alias("page_index"))
    wanted = manifest.select(P, "position", F.col("task_id").alias("a")).join(repair.select(P, "position", F.col("task_id").alias("b")), [P, "position"], "left")
    pages = projects.select(P, F.explode(F.sequence(F.lit(1), F.col("expected_count"))).alias("position")).join(wanted, [P, "position"], "left").withColumn("page_id", F.format_string("%04d", "position"))
    of_page = tasks.groupBy(P, "page_id").agg(F.count("*").alias("n"), F.first("task_id").alias("task_id"), F.first("state").alias("state"))
    both = pages.join(of_page, [P, "page_id"], "full_outer")
    one = told("a") & (F.col("a") == F.col("b")) & (F.col("n") == 1) & (F.col("task_id") == F.col("a")) & (F.col("state") == "completed") & F.col("position").isNotNull()
    return union(each, queue, broken(both, F.coalesce("page_id", F.lit("")), F.col("position"), V102=one))


def rule_use_rules(manifest: DataFrame, repair: DataFrame, rules: DataFrame, store_faults: DataFrame) -> DataFrame:
    """V103-V104: the learning store is valid (store_faults: project_id, entity), and the rules that a page names are the same in both documents and known."""
    both = repair.select(P, "position", F.col("failure_rule_ids").alias("b")).join(manifest.select(P, "position", F.col("failure_rule_ids").alias("a")), [P, "position"], "left")
    fine = F.coalesce(listed("a") & once("a") & listed("b") & once("b") & (F.col("a") == F.col("b")), F.lit(False))
    known = rules.select(P, "rule_id").distinct().withColumn("there", F.lit(True))
    uses = both.filter(fine).select(P, "position", F.explode("b").alias("rule_id")).join(known, [P, "rule_id"], "left")
    store = store_faults.select(P, F.lit("V103").alias("rule_id"), F.col("entity").cast("string").alias("entity"), F.lit(None).cast("int").alias("page_index"))
    return union(store, broken(both, page_name("position"), F.col("position"), V104=fine), broken(uses, F.col("rule_id"), F.col("position"), V104=F.col("there")))


#: What a reference may serve for.
ROLES = ("target_original", "adjacent_style", "identity_only", "composition_only", "primary_style")


def pack_ids(packs: DataFrame) -> DataFrame:
    """Adds canonical (the references with normal paths and hashes in lower case, by path and role), content_id and content_binding, rebuilt from the cluster and the references."""
    paths = normal_paths(F.transform("references", lambda r: r["path"]))
    spelled = F.zip_with("references", "paths", lambda r, p: F.struct(p.alias("path"), r["role"].alias("role"), F.lower(r["sha256"]).alias("sha256")))
    made = packs.withColumn("paths", paths).withColumn("canonical", F.array_sort(spelled)).drop("paths")
    made = made.withColumn("content_id", F.sha2(F.to_json(F.struct("cluster_id", F.col("canonical").alias("references"))), 256))
    return made.withColumn("content_binding", F.sha2(F.to_json(F.struct(F.col("content_id").alias("reference_pack_id"), F.col("canonical").alias("references"))), 256))


def sound_references(stable: Column) -> Column:
    """Whether the canonical references of a pack are some, of known roles, each once, and its primary styles are stable pages and no contaminated ones. stable: normal paths."""
    styles = F.filter("canonical", lambda r: r["role"] == "primary_style")
    marked = F.transform("canonical", lambda r: F.struct(r["path"], r["role"]))
    return (F.size("canonical") > 0) & F.forall("canonical", lambda r: r["path"].isNotNull() & r["role"].isin(*ROLES)) & once(marked) & F.forall(styles, lambda r: F.array_contains(stable, r["path"]) & ~contaminated(r["path"]))


def pack_rules(packs: DataFrame, stable: DataFrame, approved: DataFrame, files: DataFrame, clusters: DataFrame) -> DataFrame:
    """V105-V112: stable pages are listed once, packs are named once by their content, and each reference has its approved hash, which is the file's."""
    listed_ = stable.groupBy(P, "path").agg(F.count("*").alias("n"))
    of_list = broken(listed_, F.coalesce("path", F.lit("")), None, V105=told("path") & (F.col("n") == 1))
    hashes = broken(approved, F.coalesce("path", F.lit("")), None, V106=told("path") & told("sha256"))
    rows = pack_ids(packs.withColumn("first", repeats(packs, P, "reference_pack_id")))
    pages = listed_.filter(told("path")).groupBy(P).agg(F.collect_set(normal_path("path")).alias("stable_paths"))
    rows = rows.join(pages, P, "left").withColumn("stable_paths", F.coalesce("stable_paths", F.array().cast(_LIST)))
    traced = F.forall("references", lambda r: told(r["path"]) & told(r["role"]) & r["sha256"].rlike("^[0-9a-fA-F]{64}$"))
    each = broken(
        rows, F.coalesce("reference_pack_id", F.lit("")), None, V107=told("reference_pack_id") & told("cluster_id") & F.col("first"), V108=traced & sound_references(F.col("stable_paths")) & (F.col("references") == F.col("canonical")),
        V109=F.col("reference_pack_id") == F.col("content_id"), V110=F.col("reference_binding_hash") == F.col("content_binding"),
    )
    refs = packs.select(P, "reference_pack_id", F.explode("references").alias("r")).select(P, "reference_pack_id", "r.*")
    held = files.groupBy(P, "path").agg(F.first("sha256").alias("real"))
    said = approved.groupBy(P, "path").agg(F.first("sha256").alias("said"))
    files_ = broken(refs.join(held, [P, "path"], "left").join(said, [P, "path"], "left"), F.concat_ws(" ", "reference_pack_id", "path"), None, V111=safe(F.col("path")) & (F.col("sha256") == F.col("real")) & (F.col("sha256") == F.col("said")))
    owner = packs.groupBy(P, "reference_pack_id").agg(F.first("cluster_id").alias("owner"))
    bound = broken(clusters.join(owner, [P, "reference_pack_id"], "left"), F.coalesce("cluster_id", F.lit("")), None, V112=F.col("owner") == F.col("cluster_id"))
    return union(of_list, hashes, each, files_, bound)


def trace_rules(manifest: DataFrame, repair: DataFrame, clusters: DataFrame, packs: DataFrame, tasks: DataFrame) -> DataFrame:
    """V113-V119: cluster, pack, task, maker and reviewer of a page are the same in both documents, lead to the registries, and nobody reviews their own work."""
    fields = ("cluster_id", "reference_pack_id", "task_id", "generated_by", "reviewed_by")
    a = manifest.select(P, "position", "output_sha256", *(F.col(c).alias(f"a_{c}") for c in fields))
    member = clusters.select(P, F.col("cluster_id").alias("member_of"), F.col("reference_pack_id").alias("pack_of"), F.explode("member_pages").alias("wanted"))
    member = member.groupBy(P, "wanted").agg(F.max("member_of").alias("member_of"), F.max_by("pack_of", "member_of").alias("pack_of"))
    owner = pack_ids(packs).groupBy(P, "reference_pack_id").agg(F.first("cluster_id").alias("owner"), F.first("content_binding").alias("binding"))
    task = tasks.groupBy(P, "task_id").agg(F.first(F.struct("page_id", "state", "cluster_id", "candidate_hash", "completed_by", "prompt_reference_hash")).alias("task"))
    rows = repair.withColumn("wanted", page_name("position")).join(a, [P, "position"]).join(member, [P, "wanted"], "left").join(owner, [P, "reference_pack_id"], "left").join(task, [P, "task_id"], "left")
    same = lambda *names: reduce(Column.__and__, [told(c) & told(f"a_{c}") & (F.col(c) == F.col(f"a_{c}")) for c in names])
    maker, reviewer = F.col("generated_by"), F.col("reviewed_by")
    done = F.coalesce(F.col("task.state") == "completed", F.lit(False))
    resolved = (F.col("cluster_id") == F.col("member_of")) & (F.col("reference_pack_id") == F.col("pack_of")) & (F.col("owner") == F.col("cluster_id"))
    works = (F.col("task.page_id") == F.format_string("%04d", "position")) & F.col("task.cluster_id").eqNullSafe(F.col("cluster_id")) & (~done | (F.col("task.candidate_hash").eqNullSafe(F.col("output_sha256")) & F.col("task.completed_by").eqNullSafe(maker))) & (F.col("owner").isNull() | F.col("task.prompt_reference_hash").eqNullSafe(F.col("binding")))
    other = lambda c: told(c) & told(maker) & (_col(c) != maker)
    full = F.coalesce(F.col("visual_edit_mode") == "full_page_regeneration", F.lit(False))
    return broken(
        rows, F.col("wanted"), F.col("position"), V113=same("cluster_id", "reference_pack_id", "task_id"), V114=resolved, V115=same("generated_by", "reviewed_by"), V116=F.col("repair_scope").eqNullSafe("unchanged") | ~told(maker) | ~maker.eqNullSafe(reviewer),
        V117=F.col("page_qa").isNull() | reviewer.eqNullSafe(F.col("page_qa.reviewer")), V118=works, V119=~full | (other(reviewer) & other("style_review.reviewer") & other("visual_review.reviewer")),
    )


def cluster_qa_rules(clusters: DataFrame, cluster_qa: DataFrame, repair: DataFrame) -> DataFrame:
    """V120-V124: each cluster has one passed row with its members and canary, a pass id of its own, and a reviewer who made none of its pages."""
    first = clusters.groupBy(P, "cluster_id").agg(F.min_by(F.struct("member_pages", "canary_page"), "position").alias("c"))
    count = cluster_qa.groupBy(P, "cluster_id").agg(F.count("*").alias("n"))
    ids = first.select(P, "cluster_id").unionByName(count.select(P, "cluster_id")).distinct()
    per = ids.join(count, [P, "cluster_id"], "left").join(first, [P, "cluster_id"], "left")
    one = broken(per, F.coalesce("cluster_id", F.lit("")), None, V120=F.col("c").isNotNull() & (F.col("n") == 1))
    uses = cluster_qa.filter(told("pass_id")).groupBy(P, "pass_id").agg(F.count("*").alias("uses"))
    makers = repair.filter(told("generated_by")).select(P, page_name("position").alias("page"), "generated_by")
    own = first.select(P, "cluster_id", F.explode("c.member_pages").alias("page")).join(makers, [P, "page"]).select(P, "cluster_id", F.col("generated_by").alias("reviewed_by")).distinct().withColumn("own", F.lit(True))
    rows = cluster_qa.join(first, [P, "cluster_id"]).join(uses, [P, "pass_id"], "left").join(own, [P, "cluster_id", "reviewed_by"], "left")
    each = broken(
        rows, F.col("cluster_id"), None, V121=(F.col("member_pages") == F.col("c.member_pages")) & (F.col("canary_page") == F.col("c.canary_page")), V122=(F.col("status") == "passed") & told("pass_id") & (F.col("uses") == 1),
        V123=told("reviewed_by") & timed("reviewed_at"), V124=F.col("own").isNull(),
    )
    return union(one, each)


def registry_rules(registries: DataFrame) -> DataFrame:
    """V125: a registry names the hash of its document without that name."""
    recorded = F.get_json_object("body", "$.registry_hash")
    return broken(registries, F.col("document"), None, V125=told(recorded) & (recorded == json_hash(F.col("body"), "registry_hash")))


#: group -> the tables that it takes, in order
GROUPS = {
    output_rules: ("projects", "outputs"), count_rules: ("projects", "manifest", "alignment", "repair"), header_rules: ("projects", "headers"), manifest_rules: ("inputs", "manifest", "outputs"),
    lock_reference_rules: ("manifest", "repair", "locks"), alignment_rules: ("projects", "alignment"), policy_rules: ("repair",), snapshot_rules: ("repair", "files"), external_rules: ("repair", "files"),
    page_review_rules: ("repair", "batches"), batch_rules: ("projects", "batches", "repair"), report_rules: ("projects", "inputs", "outputs", "report"), bible_rules: ("projects", "bible", "coverage", "locks"),
    style_rules: ("projects", "repair", "files", "masks"), schema_rules: ("headers", "manifest", "repair", "inputs", "projects"), cluster_rules: ("projects", "clusters"), task_rules: ("projects", "manifest", "repair", "tasks", "task_faults"),
    rule_use_rules: ("manifest", "repair", "rules", "store_faults"), pack_rules: ("packs", "stable", "approved", "files", "clusters"), trace_rules: ("manifest", "repair", "clusters", "packs", "tasks"),
    cluster_qa_rules: ("clusters", "cluster_qa", "repair"), registry_rules: ("registries",),
}
EVIDENCE["store_faults"] = EVIDENCE["task_faults"] = "project_id string, entity string"


def violations(evidence: dict[str, DataFrame]) -> DataFrame:
    """All violations of the groups whose tables are there."""
    return union(*(group(*(evidence[t] for t in tables)) for group, tables in GROUPS.items() if all(t in evidence for t in tables)))
