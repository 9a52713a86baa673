"""Whole migration bundles: a sound one has no finding, each mutation has its own, and an applied bundle is sound."""

import copy
import hashlib
import json

import pytest

from panelweave.operators import migration_bundle as m
from panelweave.operators.catalogue import EVIDENCE_FILES, MODE, SCHEMA

N = 26


def spell(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(x):
    return hashlib.sha256((x if isinstance(x, str) else spell(x)).encode()).hexdigest()


def without(x, *names):
    return {k: v for k, v in x.items() if k not in names}


def name(i):
    return f"{i:04d}.jpg"


def pack(cluster, page):
    refs = [{"path": f"pages/{page}", "role": "primary_style", "sha256": sha(page)}]
    made = sha({"cluster_id": cluster, "references": refs})
    return {"reference_pack_id": made, "cluster_id": cluster, "references": refs, "reference_binding_hash": sha({"reference_pack_id": made, "references": refs})}


def proposal(state="confirmed"):
    """The documents of a proposed migration: clusters of 20 and of 6 pages, the short one blocked."""
    head = {"schema_version": SCHEMA, "pipeline_mode": MODE, "evidence_files": list(EVIDENCE_FILES), "proposal_only": True}
    groups = [("c1", 1, 20), ("c2", 21, 26)]
    packs = {c: pack(c, name(a)) for c, a, _ in groups}
    pages, log, tasks, clusters = [], [], [], []
    for c, a, b in groups:
        members = [name(i) for i in range(a, b + 1)]
        short = len(members) < 8
        clusters.append({"cluster_id": c, "member_pages": members, "source_pages": members, "undersized": short, "boundary_exception": False, "undersized_reason": "scene_fragment_below_min" if short else None, "blocked": short, "blocker_codes": ["UNDERSIZED_CLUSTER"] if short else [], "alignment_state": state, "reference_pack_id": packs[c]["reference_pack_id"], "reference_pack_state": "bound"})
        for i in range(a, b + 1):
            kind = "evidence_blocked" if short else ("unchanged", "text_only", "full_page_redraw")[i % 3]
            trace = {"output_name": name(i), "cluster_id": c, "reference_pack_id": packs[c]["reference_pack_id"], "task_id": f"t{i}", "page_class": kind}
            pages.append({"input_name": f"{i}.jpg", **trace})
            log.append({**trace, "action": m.ACTIONS[kind]})
            tasks.append({"task_id": f"t{i}", "page_id": f"{i:04d}", "task_type": "evidence_resolution" if short else "visual", "cluster_id": c, "prompt_reference_hash": packs[c]["reference_binding_hash"], "page_class": kind})
    docs = {
        m.MANIFEST: {**head, "pages": pages}, m.REPAIR: {**head, "pages": log}, m.SCENE: {"proposal_only": True, "clusters": clusters}, m.QUEUE: {"proposal_only": True, "tasks": tasks}, m.LEARNING: {"proposal_only": True, "revision": 1, "rules": []},
        m.STYLE: {"proposal_only": True, "stable_pages": [r["path"] for p in packs.values() for r in p["references"]], "approved_hashes": {r["path"]: r["sha256"] for p in packs.values() for r in p["references"]}, "reference_packs": list(packs.values())},
        m.QA: {"proposal_only": True, "clusters": [{"cluster_id": c} for c, *_ in groups]}, m.METRICS: {"proposal_only": True, "pages": N},
        m.REPORT: {"proposal_only": True, "blockers": [], "ready_for_migration": True, "exact_bijection_planned": True, "locked_sources_before": {"n.txt": sha("n")}, "output_snapshot_before": [], "image_snapshot_before": [{"path": "é.jpg", "sha256": sha("i")}], "proposal_hashes": {"x": sha("x")}},
    }
    return settled(docs)


def settled(docs):
    """Registry hashes, digest and seal as they have to be."""
    for n in m.REGISTRIES:
        if isinstance(docs.get(n), dict):
            docs[n]["registry_hash"] = sha(without(docs[n], "registry_hash"))
    report = docs[m.REPORT]
    report["confirmed_report_digest"] = sha(without(report, "migration_id", "report_integrity_hash", "confirmed_report_digest"))
    report["report_integrity_hash"] = sha(without(report, "report_integrity_hash"))
    return docs


def source_id(report, digest):
    return sha({"schema_version": SCHEMA, "locked_sources": report["locked_sources_before"], "output_snapshot": report["output_snapshot_before"], "image_snapshot": report["image_snapshot_before"], "proposal_hashes": report["proposal_hashes"], "blockers": report["blockers"], "ready_for_migration": report["ready_for_migration"], "exact_bijection_planned": report["exact_bijection_planned"], "confirmed_report_digest": digest})


def bundle():
    """An applied bundle without a fault, made here and not by the library."""
    docs = proposal()
    report = docs[m.REPORT]
    digest = report["confirmed_report_digest"]
    for n, d in docs.items():
        d["proposal_only"] = False
    settled(docs)
    return resealed(docs, source_id(report, digest), digest)


def resealed(docs, source=None, digest=None):
    report = settled(docs)[m.REPORT]
    if source:
        report |= {"source_migration_id": source, "source_confirmed_report_digest": digest}
    report["applied_hashes"] = {n: sha(d) for n, d in docs.items() if n != m.REPORT}
    report["migration_id"] = sha({"source_migration_id": report.get("source_migration_id"), "applied_hashes": report["applied_hashes"]})
    return settled(docs)


def at(doc, *path, **values):
    def change(docs):
        held = docs[doc]
        for step in path:
            held = held[step]
        held.update(values)

    return change


def gone(doc, field, i):
    return lambda docs: docs[doc][field].pop(i)


def both(*changes):
    return lambda docs: [c(docs) for c in changes]


C, K, S, M, R = (m.SCENE, "clusters"), (m.QUEUE, "tasks"), (m.STYLE, "reference_packs"), (m.MANIFEST, "pages"), (m.REPAIR, "pages")
#: a change before hashes are made anew, and what it leads to besides the gate, which always differs then
MUTATIONS = {
    "declaration_invalid": (at(m.MANIFEST, schema_version="2.0"), {"declaration_invalid"}),
    "no list": (at(m.QUEUE, tasks={"a": 1}), {"collection_missing"}),
    "inputs repeat": (at(*M, 3, input_name="1.jpg"), {"names_no_bijection"}),
    "no cluster id": (at(*C, 0, cluster_id=None), {"cluster_identity_invalid", "clusters_no_bijection", "cluster_qa_no_bijection", "page_cluster_trace_invalid", "task_binding_differs"}),
    "no members": (at(*C, 1, source_pages=None), {"cluster_membership_invalid", "clusters_no_bijection", "cluster_qa_no_bijection", "page_cluster_trace_invalid", "task_binding_differs"}),
    "size": (at(*C, 0, undersized=True), {"cluster_size_invalid"}),
    "exception": (at(*C, 1, boundary_exception=True), {"boundary_exception_invalid"}),
    "not blocked": (at(*C, 1, blocker_codes=[]), {"short_cluster_not_blocked"}),
    "marked": (at(*C, 0, undersized_reason="scene_fragment_below_min"), {"full_cluster_marked"}),
    "page twice": (at(*C, 1, member_pages=[name(i) for i in (20, 21, 22, 23, 24, 25, 26)]), {"cluster_page_repeated", "clusters_no_bijection", "page_cluster_trace_invalid", "task_binding_differs", "blocked_page_released"}),
    "order": (at(*C, 0, member_pages=[name(i) for i in (2, 1, *range(3, 21))]), {"clusters_no_bijection"}),
    "no stable list": (at(m.STYLE, stable_pages="x"), {"style_registry_invalid", "pack_invalid", "cluster_pack_unbound", "task_binding_differs"}),
    "pack without id": (at(*S, 0, reference_pack_id=None), {"pack_identity_invalid", "cluster_pack_unbound", "task_binding_differs"}),
    "pack without references": (at(*S, 0, references=None), {"pack_identity_invalid", "cluster_pack_unbound", "task_binding_differs"}),
    "unstable": (at(m.STYLE, stable_pages=["pages/0001.jpg"]), {"pack_invalid", "cluster_pack_unbound", "task_binding_differs"}),
    "role": (at(*S, 0, "references", 0, role="style"), {"pack_invalid", "cluster_pack_unbound", "task_binding_differs"}),
    "binding": (at(*S, 0, reference_binding_hash="x"), {"pack_content_differs"}),
    "approved": (at(m.STYLE, "approved_hashes", **{"pages/0001.jpg": "x"}), {"pack_hash_not_approved"}),
    "unbound": (at(*C, 0, reference_pack_state="unbound"), {"cluster_pack_unbound"}),
    "task without page": (at(*K, 0, page_id=None), {"task_identity_invalid", "tasks_no_bijection", "page_task_trace_invalid"}),
    "task twice": (at(*K, 0, page_id="0002"), {"task_page_repeated", "tasks_no_bijection", "page_task_trace_invalid"}),
    "no log row": (gone(*R, 4), {"page_mapping_invalid"}),
    "trace": (at(*R, 4, task_id="x"), {"trace_differs"}),
    "cluster of page": (both(at(*M, 4, cluster_id="c2"), at(*R, 4, cluster_id="c2")), {"page_cluster_trace_invalid"}),
    "task of page": (both(at(*M, 4, task_id="x"), at(*R, 4, task_id="x")), {"page_task_trace_invalid"}),
    "prompt": (at(*K, 4, prompt_reference_hash="x"), {"task_binding_differs"}),
    "class": (at(*R, 4, page_class="text"), {"page_class_differs"}),
    "action": (at(*R, 4, action="redo"), {"page_action_differs"}),
    "task class": (at(*K, 4, page_class="text_only" if 5 % 3 != 1 else "unchanged"), {"task_class_differs"}),
    "released": (at(*K, 24, task_type="visual"), {"blocked_page_released"}),
    "qa": (gone(m.QA, "clusters", 0), {"cluster_qa_no_bijection"}),
}
#: a change after all hashes are made
LATE = {
    "missing": (lambda docs: docs.pop(m.QA), {"document_missing", "applied_hashes_differ", "gate_differs"}),
    "no report": (lambda docs: docs.pop(m.REPORT), {"document_missing"}),
    "registry": (at(m.LEARNING, revision=2), {"registry_hash_differs", "applied_hashes_differ", "gate_differs"}),
    "metrics": (at(m.METRICS, pages=1), {"applied_hashes_differ"}),
    "seal": (at(m.REPORT, report_integrity_hash="x"), {"integrity_hash_malformed", "integrity_hash_differs"}),
    "digest": (at(m.REPORT, confirmed_report_digest=sha("x")), {"digest_differs", "integrity_hash_differs"}),
}
#: a change of the report, sealed again
REPORTS = {
    "source id": (at(m.REPORT, source_migration_id=sha("x")), {"source_id_differs"}), "no source id": (at(m.REPORT, source_migration_id=None), {"source_id_missing"}), "ready": (at(m.REPORT, ready_for_migration=False), {"gate_differs"}),
    "blockers": (at(m.REPORT, blockers=[{"code": "X"}]), {"gate_differs"}), "snapshot": (at(m.REPORT, image_snapshot_before=[]), {"source_id_differs"}),
}


def frames(spark, bundles, state="confirmed"):
    docs = [(p, n, json.dumps(d, ensure_ascii=False)) for p, b in bundles.items() for n, d in b.items()]
    aligned = [(p, name(i), f"{i}", state) for p in bundles for i in range(1, N + 1)]
    return spark.createDataFrame(docs, "project_id string, name string, body string"), spark.createDataFrame(aligned, "project_id string, output_name string, page string, state string")


@pytest.fixture(scope="module")
def found(spark):
    cases, want = {"sound": bundle()}, {"sound": set()}
    for kinds, remake in ((MUTATIONS, resealed), (REPORTS, settled), (LATE, None)):
        for n, (change, faults) in kinds.items():
            docs = copy.deepcopy(cases["sound"])
            change(docs)
            if remake:
                remake(docs)
            cases[n], want[n] = docs, faults | ({"gate_differs"} if kinds is MUTATIONS else set())
    seen = {n: set() for n in cases}
    for r in m.bundle_faults(*frames(spark, cases)).collect():
        seen[r.project_id].add(r.fault)
    return seen, want


@pytest.mark.parametrize("case", ["sound", *MUTATIONS, *LATE, *REPORTS])
def test_each_mutation_has_its_finding(found, case):
    assert found[0][case] == found[1][case]


def test_an_applied_bundle_is_sound_and_says_what_it_was_made_of(spark):
    docs = proposal()
    report = docs[m.REPORT]
    source = source_id(report, report["confirmed_report_digest"])
    frame, aligned = frames(spark, {"p": docs})
    made, bundles = m.applied(frame, spark.createDataFrame([("p", source)], "project_id string, source_id string"))
    assert m.bundle_faults(made, aligned).collect() == []
    want = bundle()
    assert {r.name: r.body for r in made.collect()} == {n: spell(d) for n, d in want.items()}
    assert bundles.first().migration_id == want[m.REPORT]["migration_id"]


def test_unconfirmed_pages_block_the_gate(spark):
    docs = proposal("provisional")
    frame, aligned = frames(spark, {"p": docs}, "provisional")
    live = m.live_gate(frame, m.document_faults(frame), aligned, []).first()
    assert not live.ready and live.exact_bijection and [json.loads(x)["code"] for x in live.blockers] == ["UNCONFIRMED_ALIGNMENT_PAGES"]
