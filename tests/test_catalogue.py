"""The rule catalogue on a project that passes every rule, and on mutations that each break the rules named."""

import copy
import hashlib
import json

import pytest

from panelweave.operators import catalogue as c

N, TIME, LATER = 25, "2026-07-13T08:00:00+08:00", "2026-07-14T08:00:00Z"
NOVEL = "a story of twenty-five pages " * 20
PASSED = ("p",)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def name(i):
    return f"{i:04d}.jpg"


def compact(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def pack(cluster, canary):
    refs = sorted([{"path": f"pages/{name(canary)}", "role": "primary_style", "sha256": sha(f"ref{canary}")}, {"path": "pages/0001.jpg", "role": "adjacent_style", "sha256": sha("ref1")}], key=lambda r: (r["path"], r["role"]))
    made = sha(compact({"cluster_id": cluster, "references": refs}))
    return {"reference_pack_id": made, "cluster_id": cluster, "references": refs, "reference_binding_hash": sha(compact({"reference_pack_id": made, "references": refs}))}


def passing():
    """Evidence of one project without a fault, as lists of rows."""
    names = [name(i) for i in range(1, N + 1)]
    groups, clusters, packs = [("c1", 1, 13, 5), ("c2", 14, 25, 20)], [], []
    for position, (cid, a, b, canary) in enumerate(groups, 1):
        packs.append(pack(cid, canary))
        clusters.append({"position": position, "cluster_id": cid, "member_pages": names[a - 1 : b], "undersized": False, "boundary_exception": False, "undersized_reason": None, "context_before": names[max(0, a - 3) : a - 1], "context_after": names[b : b + 2], "canary_page": name(canary), "reference_pack_state": "bound", "reference_pack_id": packs[-1]["reference_pack_id"]})
    manifest, alignment, repair, tasks, batches = [], [], [], [], []
    for i in range(1, N + 1):
        k = 0 if i <= 13 else 1
        trace = {"cluster_id": groups[k][0], "reference_pack_id": packs[k]["reference_pack_id"], "task_id": f"t{i}", "failure_rule_ids": ["r1"], "generated_by": "maker", "reviewed_by": "reader"}
        manifest.append({"position": i, "index": i, "input_name": f"{i}.jpg", "output_name": name(i), "input_sha256": sha(f"in{i}"), "state": c.DONE, "output_sha256": sha(f"out{i}"), "continuity_lock_ids": ["l1"], **trace})
        alignment.append({"position": i, "index": i, "output_name": name(i), "status": "confirmed", "evidence": "seen", "novel_sha256": sha(NOVEL), "chapter": "1", "context_excerpt": "x", "located_by": "y", "located_at": TIME, "scene_summary": "s", "location": "here", "story_time": "day", "involved_characters": ["a"], "dialogue_owners": [], "props": [], "start_offset": i, "end_offset": i + 9, "source_excerpt": NOVEL[i : i + 9], "confidence": 0.5})
        quiet = {"status": "not_applicable", "full_size": False, "reviewer": None, "reviewed_at": None, "comparison_path": None, "comparison_sha256": None, "full_page_exception_approved": False, "checks": {x: False for x in c.STYLE_CHECKS}}
        seen = {"status": "passed", "full_size": True, "reviewer": "styler", "reviewed_at": TIME, "comparison_path": "work/compare.png", "comparison_sha256": sha("compare"), "full_page_exception_approved": False, "checks": {x: True for x in c.STYLE_CHECKS}}
        row = {"position": i, "index": i, "output_name": name(i), "continuity_lock_ids": ["l1"], "candidate_path": f"work/{i}.jpg", "candidate_sha256": sha(f"cand{i}"), "text_snapshot_path": "work/text.json", "text_snapshot_sha256": sha("text"), "used_external": False, "external_candidate": None, "batch_id": f"b{1 if i <= 9 else 2 if i <= 17 else 3}", **trace}
        row["visual_review"] = {"status": "passed", "full_size": True, "reviewer": "looker", "reviewed_at": TIME, "checks": {x: True for x in c.VISUAL_CHECKS}}
        row["page_qa"] = {"status": "passed", "pass_id": f"q{i}", "reviewer": "reader", "reviewed_at": TIME, "checks": {x: True for x in c.PAGE_CHECKS}}
        plain = {"style_reference_pages": [], "identity_reference_files": [], "character_reference_role": "not_applicable", "visual_mask_path": None, "visual_mask_sha256": None, "changed_region_ratio": 0.0, "full_page_regeneration_reason": None, "visual_edit_mode": "not_applicable", "visual_issue_extent": "not_applicable", "style_review": quiet}
        if i == 3:  # localized
            row |= {"action": "edited", "repair_scope": "visual", "had_ordinary_text": True, "text_recognition": "reliable", "text_reset_mode": "page", "text_reset_reason": "visual_repair_requires_page_reset"}
            row |= plain | {"style_reference_pages": [name(2), name(9)], "identity_reference_files": ["a.png"], "character_reference_role": "identity_only", "visual_mask_path": "work/mask.png", "visual_mask_sha256": sha("mask"), "changed_region_ratio": 0.25, "visual_edit_mode": "localized_inpaint", "visual_issue_extent": "localized", "style_review": seen}
        elif i == 4:  # a whole page
            row |= {"action": "edited", "repair_scope": "visual", "had_ordinary_text": False, "text_recognition": "not_applicable", "text_reset_mode": "none", "text_reset_reason": "no_ordinary_text"}
            row |= plain | {"style_reference_pages": [name(5)], "visual_mask_path": "work/full.png", "visual_mask_sha256": sha("full"), "changed_region_ratio": 1.0, "visual_edit_mode": "full_page_regeneration", "visual_issue_extent": "page_wide", "full_page_regeneration_reason": "all of it", "style_review": seen | {"full_page_exception_approved": True}}
        elif i == 6:
            row |= {"action": "edited", "repair_scope": "text_only", "had_ordinary_text": True, "text_recognition": "reliable", "text_reset_mode": "block", "text_reset_reason": "reliable_block_match"} | plain
        else:
            row |= {"action": "unchanged_copy", "repair_scope": "unchanged", "had_ordinary_text": True, "text_recognition": "not_applicable", "text_reset_mode": "none", "text_reset_reason": "unchanged_page"} | plain
        if i == 7:
            row |= {"used_external": True, "external_candidate": {"run_dir": "D:\\runs\\mend_20260713_080000", "source_path": "D:/runs/mend_20260713_080000/final/7.jpg", "source_sha256": sha("cand7"), "imported_at": TIME, "imported_by": "me", "status": "supervised_import"}}
        repair.append(row)
        tasks.append({"task_id": f"t{i}", "page_id": f"{i:04d}", "state": "completed", "cluster_id": groups[k][0], "candidate_hash": sha(f"out{i}"), "completed_by": "maker", "prompt_reference_hash": packs[k]["reference_binding_hash"]})
    for position, (a, b) in enumerate(((1, 9), (10, 17), (18, 25)), 1):
        batches.append({"position": position, "batch_id": f"b{position}", "member_pages": names[a - 1 : b], "context_before": names[max(0, a - 3) : a - 1], "context_after": names[b : b + 2], "batch_qa": {"status": "passed", "pass_id": f"bq{position}", "reviewer": "chief", "reviewed_at": LATER, "checks": {x: True for x in c.BATCH_CHECKS}}})
    lock = {"fields": list(reversed(c.LOCK_FIELDS)), "category": "character", "subject": "s", "attribute": "a", "value": "v", "source_type": "novel", "source_ref": "r", "applies_to_pages": names, "confidence": 1.0, "created_by": "x", "created_at": TIME, "confirmed": True, "reviewer": "y", "reviewed_at": TIME}
    paths = {**{f"work/{i}.jpg": sha(f"cand{i}") for i in range(1, N + 1)}, "work/text.json": sha("text"), "work/compare.png": sha("compare"), "work/mask.png": sha("mask"), "work/full.png": sha("full"), "人物参考图/a.png": sha("a"), "pages/0001.jpg": sha("ref1"), "pages/0005.jpg": sha("ref5"), "pages/0020.jpg": sha("ref20"), repair[6]["external_candidate"]["source_path"]: sha("cand7")}
    values = dict(zip(c.REPORT_KEYS, ("passed", "chief", LATER, N, N, N, 3, 3, 0, 0)))
    head = {"status": c.DONE, "expected_count": N, "novel_name": "n.txt", "novel_sha256": sha(NOVEL), "schema_version": c.SCHEMA, "pipeline_mode": c.MODE, "evidence_files": list(c.EVIDENCE_FILES)}
    registry = {"clusters": [1, 2], "revision": 3}
    return {
        "projects": [{"expected_count": N, "novel_name": "n.txt", "novel_sha256": sha(NOVEL), "novel_text": NOVEL}], "inputs": [{"index": i, "input_name": f"{i}.jpg", "input_sha256": sha(f"in{i}")} for i in range(1, N + 1)],
        "outputs": [{"name": name(i), "sha256": sha(f"out{i}"), "is_file": True, "decodable": True} for i in range(1, N + 1)], "files": [{"path": k, "sha256": v} for k, v in paths.items()],
        "headers": [{"document": "manifest", **head}, {"document": "repair", **head}, {"document": "alignment", **head, "status": "confirmed"}], "manifest": manifest, "alignment": alignment, "repair": repair,
        "masks": [{"path": "work/mask.png", "coverage": 0.255, "same_size": True}, {"path": "work/full.png", "coverage": 1.0, "same_size": True}], "bible": [{"status": "confirmed", "reviewer": "r", "reviewed_at": TIME, "source_priority": list(c.SOURCE_TYPES)}],
        "coverage": [{"category": x, "status": "confirmed" if x == "character" else "not_applicable", "rationale": "none here", "lock_ids": ["l1"] if x == "character" else []} for x in c.CATEGORIES],
        "locks": [{"position": 1, "lock_id": "l1", **lock}], "batches": batches, "report": [{"line_no": 1, "line": c.REPORT_TITLE}, {"line_no": 2, "line": ""}, *({"line_no": n, "line": f"{k}: {v}"} for n, (k, v) in enumerate(values.items(), 3))],
        "clusters": clusters, "tasks": tasks, "rules": [{"rule_id": "r1"}], "packs": packs, "stable": [{"path": "pages/0005.jpg"}, {"path": "pages/0020.jpg"}], "approved": [{"path": r["path"], "sha256": r["sha256"]} for r in {r["path"]: r for p in packs for r in p["references"]}.values()],
        "cluster_qa": [{"position": n, "cluster_id": x["cluster_id"], "member_pages": x["member_pages"], "canary_page": x["canary_page"], "status": "passed", "pass_id": f"cq{n}", "reviewed_by": "other", "reviewed_at": TIME} for n, x in enumerate(clusters, 1)],
        "registries": [{"document": "scene_clusters", "body": json.dumps(registry | {"registry_hash": sha(json.dumps(registry, sort_keys=True, separators=(",", ":")))})}], "store_faults": [], "task_faults": [],
    }


def put(table, at, **values):
    def change(e):
        for key, value in values.items():
            held = e[table][at]
            *path, last = key.split("__")
            for step in path:
                held = held[step]
            held[last] = value

    return change


def drop(table, at):
    return lambda e: e[table].pop(at)


def add(table, **row):
    return lambda e: e[table].append({**(e[table][-1] if e[table] else {}), **row})


#: what is changed, and the rules that this breaks
MUTATIONS = [
    (drop("outputs", 4), "V01 V02 V03 V13 V58"), (add("outputs", name="notes.txt"), "V03"), (add("outputs", name="0026.jpg"), "V01 V02 V03 V58"), (put("outputs", 2, decodable=False), "V04"), (drop("alignment", 24), "V05"),
    (put("headers", 0, status="open"), "V06"), (put("headers", 0, expected_count=9), "V07"), (put("headers", 0, novel_name="m.txt"), "V08"), (put("headers", 2, status="open"), "V09"), (put("headers", 1, status="open"), "V09"),
    (put("manifest", 1, index=7), "V10"), (put("manifest", 1, input_sha256="x"), "V11"), (put("manifest", 1, state="open"), "V12"), (put("manifest", 1, output_sha256="x"), "V13 V118"), (put("manifest", 1, continuity_lock_ids=[]), "V14 V27"),
    (lambda e: [put("manifest", 1, continuity_lock_ids=["l9"])(e), put("repair", 1, continuity_lock_ids=["l9"])(e)], "V15 V26"), (put("locks", 0, applies_to_pages=[name(i) for i in range(2, N + 1)]), "V16 V26"),
    (put("alignment", 0, index=2), "V17"), (put("alignment", 0, evidence=" "), "V18"), (put("alignment", 0, novel_sha256="x"), "V19"), (put("alignment", 0, story_time=None), "V20"), (put("alignment", 0, involved_characters=[]), "V21"), (put("alignment", 0, props=None), "V21"),
    (put("alignment", 0, end_offset=10_000), "V22"), (put("alignment", 0, source_excerpt="zz"), "V23"), (put("alignment", 0, confidence=1.5), "V24"), (put("repair", 0, output_name="x"), "V25 V89"), (put("repair", 0, continuity_lock_ids=["l1", "l1"]), "V26"),
    (put("repair", 0, action="redrawn"), "V28 V33"), (put("repair", 0, text_reset_mode="x"), "V29 V33"), (put("repair", 0, repair_scope="x"), "V30 V33"), (put("repair", 0, text_recognition="x"), "V31 V33"), (put("repair", 0, text_reset_reason=" "), "V32 V33"), (put("repair", 5, had_ordinary_text=False), "V33"),
    (put("repair", 0, candidate_path="../x.jpg"), "V34"), (put("repair", 0, candidate_path="a/../../x.jpg"), "V34"), (put("repair", 0, candidate_path="work/none.jpg"), "V35"), (put("repair", 0, text_snapshot_sha256="x"), "V36"),
    (put("repair", 0, used_external=True), "V37"), (put("repair", 6, used_external=False), "V37"), (put("repair", 6, external_candidate__status="x"), "V37"), (put("repair", 6, external_candidate__run_dir="D:/runs/other"), "V37"),
    (put("repair", 0, visual_review__status="x"), "V38"), (put("repair", 0, visual_review__reviewer=""), "V39"), (put("repair", 0, visual_review__reviewed_at="2026-07-13T08:00:00"), "V40"), (put("repair", 0, visual_review__checks={}), "V41"),
    (put("repair", 0, page_qa__status="x"), "V42"), (put("repair", 0, page_qa__pass_id="bq1"), "V43"), (put("repair", 0, page_qa__reviewer=" "), "V44 V117"), (put("repair", 0, page_qa__reviewed_at="soon"), "V45"), (put("repair", 0, page_qa__checks={"sfx": True}), "V46"),
    (drop("batches", 2), "V47 V52 V55"), (put("batches", 1, batch_id="b1"), "V48 V55"), (put("batches", 1, member_pages=[name(i) for i in (10, 12, 11, 13, 14, 15, 16, 17)]), "V50"), (put("batches", 1, context_before=[name(9)]), "V51"), (put("batches", 1, batch_qa__checks={}), "V53"), (put("batches", 1, batch_qa__reviewed_at=TIME), "V54"),
    (put("repair", 0, batch_id="b2"), "V55"), (put("report", 0, line="# REPORT"), "V56"), (put("report", 2, line="status: open"), "V57"), (put("report", 5, line="input_count: 24"), "V58"), (put("report", 11, line="unresolved_issues: one"), "V58"), (drop("report", 3), "V56 V57"),
    (put("bible", 0, status="x"), "V59"), (put("bible", 0, reviewer=None), "V60"), (put("bible", 0, reviewed_at="x"), "V61"), (put("bible", 0, source_priority=["novel"]), "V62"), (put("locks", 0, fields=["lock_id"]), "V64"), (add("locks", position=2), "V65"), (put("locks", 0, source_type="x"), "V66"),
    (put("locks", 0, confirmed=False), "V67"), (put("locks", 0, applies_to_pages=[name(i) for i in range(1, N + 2)]), "V68"), (put("locks", 0, confidence=-0.1), "V69"), (put("coverage", 1, status="x"), "V70"), (put("coverage", 0, lock_ids=[]), "V71"), (put("coverage", 1, status="confirmed"), "V71"), (put("coverage", 1, rationale=None), "V72"),
    (put("repair", 0, changed_region_ratio=0.1), "V73"), (put("repair", 2, visual_edit_mode="x"), "V74"), (put("repair", 2, visual_issue_extent="x"), "V75 V85"), (put("repair", 2, style_reference_pages=[name(99)]), "V76"), (put("repair", 2, style_reference_pages=[name(9)]), "V77"), (put("repair", 2, identity_reference_files=["z.png"]), "V78"),
    (put("repair", 2, visual_mask_sha256="x"), "V79"), (put("repair", 2, changed_region_ratio=0.0), "V80 V81"), (put("repair", 2, changed_region_ratio=0.4), "V81"), (put("repair", 2, style_review__full_size=False), "V82"), (put("repair", 2, style_review__checks={}), "V83"), (put("repair", 2, style_review__comparison_sha256="x"), "V84"), (put("repair", 3, full_page_regeneration_reason=None), "V85"),
    (put("headers", 0, schema_version="9"), "V86"), (put("headers", 0, pipeline_mode=None), "V87"), (put("headers", 0, evidence_files=["x"]), "V88"), (put("manifest", 0, input_name="z.jpg"), "V11 V89"),
    (put("clusters", 0, cluster_id=" "), "V90 V94 V95 V98 V114 V112 V120"), (put("clusters", 1, undersized=True), "V92 V93"), (put("clusters", 1, context_before=[]), "V95"), (put("clusters", 1, canary_page=name(1)), "V96 V121"), (put("clusters", 1, reference_pack_state="open"), "V97"),
    (add("tasks", page_id="0099"), "V99 V102"), (put("tasks", 0, state="queued"), "V100 V102"), (put("tasks", 0, state="lost"), "V100 V102"), (add("task_faults", entity="t1"), "V101"), (put("tasks", 0, page_id="0002"), "V102 V118"), (add("store_faults", entity="r1"), "V103"), (put("repair", 0, failure_rule_ids=["r9"]), "V104"),
    (add("stable"), "V105"), (put("approved", 0, sha256=" "), "V106 V111"), (put("packs", 0, cluster_id="c9"), "V109 V110 V112 V114 V118"), (put("packs", 0, reference_binding_hash="x"), "V110"), (drop("stable", 0), "V108"),
    (put("manifest", 0, cluster_id="c2"), "V113"), (put("repair", 0, generated_by=None), "V115 V118"), (lambda e: [put(t, 5, reviewed_by="maker")(e) for t in ("manifest", "repair")], "V116 V117"), (put("tasks", 0, completed_by="x"), "V118"), (put("repair", 3, style_review__reviewer="maker"), "V119"),
    (drop("cluster_qa", 0), "V120"), (put("cluster_qa", 0, canary_page=name(2)), "V121"), (put("cluster_qa", 0, pass_id="cq2"), "V122"), (put("cluster_qa", 0, reviewed_at="x"), "V123"), (put("cluster_qa", 0, reviewed_by="maker"), "V124"), (put("registries", 0, body='{"registry_hash":"x"}'), "V125"),
    (lambda e: e["coverage"].clear(), "V63 V70"), (lambda e: [put("clusters", 1, member_pages=[name(14)] * 12)(e), put("cluster_qa", 1, member_pages=[name(14)] * 12)(e)], "V91 V98 V114"), (add("packs"), "V107"),
    (lambda e: [put("batches", 1, member_pages=[name(i) for i in range(10, 19)])(e), put("batches", 2, member_pages=[name(i) for i in range(19, 26)])(e)], "V49 V51 V55"),
]


@pytest.fixture(scope="module")
def found(spark):
    """All mutated projects in one set of tables: project -> rules broken."""
    sets = [passing()]
    for change, _ in MUTATIONS:
        sets.append(copy.deepcopy(sets[0]))
        change(sets[-1])
    tables = {}
    for table, schema in c.EVIDENCE.items():
        names = spark.createDataFrame([], schema).columns
        rows = [tuple({"project_id": f"p{n}", **row}.get(x) for x in names) for n, e in enumerate(sets) for row in e[table]]
        tables[table] = spark.createDataFrame(rows, schema)
    out = {}
    for group, needs in c.GROUPS.items():
        for r in group(*(tables[t] for t in needs)).distinct().collect():
            out.setdefault(r.project_id, set()).add(r.rule_id)
    return out




def test_a_sound_project_breaks_no_rule(found):
    assert found.get("p0", set()) == set()


def test_each_mutation_breaks_its_rules(found):
    wrong = {n: (found.get(f"p{n}", set()) ^ set(rules.split()), rules) for n, (_, rules) in enumerate(MUTATIONS, 1) if found.get(f"p{n}", set()) != set(rules.split())}
    assert not wrong


def test_every_rule_is_broken_by_some_mutation():
    named = {r for _, rules in MUTATIONS for r in rules.split()}
    assert {f"V{n:02d}" for n in range(1, 126)} == named
