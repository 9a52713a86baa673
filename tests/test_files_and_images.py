"""File and image sources on small trees that the tests write, and operators on fixed rows."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelweave.functions.text import contaminated, inside, json_hash, nfkc, normal_path, trimmed, zoned_time
from panelweave.operators import audits, dispatch, evidence, packs, preflight
from panelweave.sources import files, images


def png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def tree(tmp_path):
    for name in ("10.jpg", "2.jpg", "1(2).JPG", "cover.png"):
        (tmp_path / "p1" / "input").mkdir(parents=True, exist_ok=True)
        (tmp_path / "p1" / "input" / name).write_bytes(name.encode())
    (tmp_path / "p1" / "page_candidates").mkdir()
    (tmp_path / "p1" / "page_candidates" / "3.png").write_bytes(b"c")
    return tmp_path


def test_inventory(spark, tree):
    found = files.files(spark, str(tree))
    rows = files.inventory(found).orderBy("index").collect()
    assert [(r.project_id, r.name, r.output_name) for r in rows] == [("p1", "1(2).JPG", "0001.jpg"), ("p1", "2.jpg", "0002.jpg"), ("p1", "10.jpg", "0003.jpg")]
    assert {r.name for r in files.unexpected(found).collect()} == {"cover.png", "3.png"}
    assert files.rejected(found).count() == 1
    assert files.snapshot(found, "input", "page_candidates").count() == 4
    assert {r.fault for r in files.project_faults(found, ("input", "output")).collect()} == {"novel_not_one", "folder_missing:output"}
    assert [r.name for r in files.reference_sheets(found).orderBy("index").collect()][0] == "1(2).JPG"


def test_evidence_encodings(spark, tmp_path):
    for name, raw in {"a": b'{"x":1}', "b": b"\xef\xbb\xbf{\"x\":1}", "c": '{"x":"é"}'.encode("utf-16"), "d": b"{", "e": b"[1]", "f": b"\xff{}"}.items():
        (tmp_path / f"{name}.json").write_bytes(raw)
    rows = {r.path[-6]: (r.document, r.blocker) for r in files.evidence(spark, str(tmp_path)).collect()}
    assert rows["a"] == rows["b"] == ('{"x":1}', None) and rows["c"][0] == '{"x":"é"}'
    assert all(rows[x] == (None, "EVIDENCE_JSON_UNREADABLE") for x in "def")


def test_document_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pages": [{"name": "1"}, {"name": "2"}]}))
    (tmp_path / "b.json").write_text("{ no")
    rows = files.document_pages(spark, str(tmp_path), StructType([StructField("name", StringType())])).collect()
    assert sorted((r.path[-6], r.position, r.name, r.corrupt) for r in rows if r.corrupt is None) == [("a", 1, "1", None), ("a", 2, "2", None)]
    assert sum(r.corrupt is not None for r in rows) == 1


def test_reports_and_novels(spark, tmp_path):
    good, bad = tmp_path / "good.md", tmp_path / "bad.md"
    good.write_text("# FINAL QA REPORT\n\nstatus: passed \nreviewer: R\n")
    bad.write_text("# FINAL QA REPORT\nreviewer: R\nstatus: passed\nstatus: failed\n")
    rows = {r.path.split("/")[-1]: r for r in files.reports(spark, str(tmp_path), ("status", "reviewer")).collect()}
    assert rows["good.md"].format_ok and rows["good.md"]["values"] == {"status": "passed", "reviewer": "R"}
    assert not rows["bad.md"].format_ok and rows["bad.md"]["values"]["status"] == "passed"
    assert files.novels(spark, str(good)).first().text.startswith("# FINAL")


def test_image_metrics(spark, tmp_path):
    stripes = np.zeros((12, 10, 3), dtype=np.uint8)
    stripes[:, ::2] = (200, 100, 50)
    mask = np.zeros((48, 32, 3), dtype=np.uint8)
    mask[:24, :16] = 255
    for name, raw in {"stripes": png(stripes), "mask": png(mask), "broken": b"no image"}.items():
        (tmp_path / f"{name}.png").write_bytes(raw)
    metrics = images.image_metrics(spark, str(tmp_path))
    rows = {r.path.split("/")[-1][:-4]: r for r in metrics.collect()}
    assert not rows["broken"].decodable and rows["broken"].rgb_mean is None
    assert (rows["mask"].width, rows["mask"].height, rows["mask"].nonzero_ratio) == (32, 48, 0.25)
    assert rows["stripes"].rgb_mean == [100.0, 50.0, 25.0] and rows["stripes"].edge_density == 0.5
    grey = (200 * 19595 + 100 * 38470 + 50 * 7471 + 0x8000) >> 16
    assert rows["stripes"].grayscale_variance == round((grey / 2) ** 2, 6)
    told = metrics.withColumn("ratio", F.lit(0.3)).withColumn("page_width", F.lit(32)).withColumn("page_height", F.lit(48)).filter("path like '%mask%'")
    assert [r.fault for r in images.mask_faults(told).collect()] == ["ratio_differs"]
    path = {k: r.path for k, r in rows.items()}
    pairs = spark.createDataFrame([(path["stripes"], path["stripes"]), (path["broken"], path["stripes"]), (path["mask"], path["stripes"])], "candidate string, original string")
    pairs = pairs.withColumn("policy", F.lit("textless")).withColumn("ocr_ok", F.lit(True))
    found = {r.candidate: (r.status, [c.status for c in r.checks]) for r in preflight.preflight(images.compared(metrics, pairs)).collect()}
    assert found[path["stripes"]][0] == "pass"
    assert found[path["broken"]] == ("fail", ["fail"] + ["blocked"] * 5 + ["pass"])
    assert found[path["mask"]][1][1] == "fail"


def test_text_helpers(spark):
    df = spark.createDataFrame([("A\\B\\..\\Ｃ-Sheet.png", '{"b":1,"a":"字","h":0}', "2026-07-13T08:00:00Z"), (" ", "[1]", "2026-07-13T08:00:00"), (None, None, None)], "p string, j string, t string")
    rows = df.select(normal_path("p").alias("p"), json_hash(F.col("j"), "h").alias("j"), zoned_time(F.col("t")).isNotNull().alias("t"), trimmed(nfkc("p")).isNull().alias("blank")).collect()
    assert [r.p for r in rows] == ["a/c-sheet.png", None, None]
    assert rows[0].j == json_digest({"a": "字", "b": 1}) and rows[1].j is None and rows[2].j is None
    assert [r.t for r in rows] == [True, False, False] and [r.blank for r in rows] == [False, True, True]
    marks = spark.createDataFrame([("x/identity-sheet.png",), ("x/page.png",), ("../y",)], "p string")
    assert [tuple(r) for r in marks.select(contaminated(F.col("p")), inside(F.col("p"), F.lit("x"))).collect()] == [(True, True), (False, True), (False, False)]


def json_digest(x):
    import hashlib

    return hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_packs_find_their_faults(spark):
    refs = spark.createDataFrame([("a", "p/1.jpg", "primary_style"), ("a", "p/2.jpg", "adjacent_style"), ("b", "p/rejected.jpg", "primary_style"), ("b", "p/1.jpg", "primary_style")], "cluster_id string, path string, role string")
    assert sorted((r.cluster_id, r.fault) for r in packs.pack_faults(refs).collect()) == [("b", "adjacent_style_missing"), ("b", "primary_style_not_one"), ("b", "style_contaminated")]


def test_lookups_and_sets(spark):
    pages = spark.createDataFrame([("p", 1, "a"), ("p", 2, "x"), ("p", 3, "z"), ("o", 9, "a")], "project_id string, i long, name string")
    rows = spark.createDataFrame([("p", 9, "a", "v1"), ("p", 2, "q", "v2"), ("p", 5, "z", "v3"), ("p", 6, "z", "v4")], "project_id string, i2 long, n2 string, value string")
    found = {r.i: (r.by, r.value, r.ambiguous) for r in evidence.first_by_priority(pages, rows, [("name", "n2"), ("i", "i2")], "value").collect()}
    assert found == {1: ("n2", "v1", False), 2: ("i2", "v2", False), 3: ("n2", None, True), 9: (None, None, None)}
    a, b = (spark.createDataFrame(x, "k long, m string") for x in ([(1, "x"), (1, "y"), (2, "x")], [(1, "y"), (1, "x"), (3, "z")]))
    assert sorted(map(tuple, evidence.set_differences(a, b, "k", "m").collect())) == [(2, 1, 0), (3, 0, 1)]


def test_states_and_chains(spark):
    events = spark.createDataFrame([(0, 1, 1, 1, "add"), (0, 1, 2, 2, "complete"), (0, 2, 3, 3, "add")], "project_id long, lane long, event_id long, t long, kind string").withColumn("ts", F.timestamp_seconds("t"))
    assert [tuple(r) for r in dispatch.state_faults(dispatch.task_rows(events)).collect()] == [(1, "ended_without_lease")]
    assert [r.lane for r in dispatch.next_tasks(events).collect()] == [2]
    rules = spark.createDataFrame([(1, "s", True), (2, "s", True)], "rule_id long, signature string, active boolean")
    sources = spark.createDataFrame([(1, "s", 1, False), (1, "s", 2, True), (2, "t", 1, False)], "rule_id long, signature string, place long, revoked boolean")
    assert sorted(map(tuple, audits.chain_faults(rules, sources).collect())) == [(1, "active_on_revoked_source"), (2, "signature_differs"), (2, "too_few_sources")]
