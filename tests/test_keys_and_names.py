"""Keys of pages, candidates and paths, on fixed values."""

import ntpath
import random
import unicodedata

from pyspark.sql import functions as F

from panelweave.functions.columns import natural_key, page_key
from panelweave.functions.text import normal_path, page_id
from panelweave.operators.clusters import keyed, scene_keyed
from panelweave.operators.migration import bound_candidates, candidate_page, page_in_range
from panelweave.operators import bundle, evidence, sequence


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def ordered(key):
    """A struct's order, null first."""
    return tuple((x is not None, [tuple(t) for t in x] if isinstance(x, list) else x) if x is not None else (False,) for x in key)


def test_inserts_stand_after_their_page(spark):
    for want in (["252.jpg", "252（1）.jpg", "252 ( 2 ).JPG", "253.jpg"], ["1.jpg", "２.jpg", "03.jpg", "1a.jpg", "1b.jpg", "a1.jpg", "a2.jpg", "a10.jpg", "b（1）.jpg"], ["5.jpg", "straße1.jpg", "STRASSE2.jpg", "strasse10.jpg"]):
        keys = dict(zip(want, column(spark, want, natural_key)))
        assert sorted(want[::-1], key=lambda n: ordered(keys[n])) == want
        df = spark.createDataFrame([("p", i, n) for i, n in enumerate(want[::-1])], "project_id string, page_id long, name string")
        assert [r.name for r in sequence.story_index(df).orderBy("index").collect()] == want


def test_pages_that_are_one_page(spark):
    same = [["007.jpg", "7.jpeg", " ７.jpg", "7(0).jpg"], ["7（1）.jpg", "7 (01).JPEG"], ["Cover A.jpg", "covera.jpg", "COVER　a.jpeg"], ["straße.jpg", "STRASSE.jpg"]]
    keys = [column(spark, names, page_key) for names in same]
    assert all(len(set(k)) == 1 for k in keys) and len({k[0] for k in keys}) == 4
    rows = [("p", 1, "007.jpg"), ("p", 2, "7.jpg"), ("p", 3, "7(1).jpg"), ("q", 4, "7.jpg"), ("q", 5, "8.jpg")]
    assert sorted(r.page_id for r in sequence.repeated_pages(spark.createDataFrame(rows, "project_id string, page_id long, name string")).collect()) == [1, 2]


def test_projects_of_equal_names_do_not_meet(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pages = frame([("b", "12")], "project_id string, page string")
    found = bound_candidates(frame([("a", 1, "x/12_candidate.png"), ("b", 2, "x/12_candidate.png")], "project_id string, k long, path string"), pages, "k")
    assert {(r.project_id, r.k): r.page for r in found.collect()} == {("a", 1): None, ("b", 2): "12"}
    packs = frame([("a", "r", "s/1.jpg", "primary_style"), ("b", "r", "s/1.jpg", "primary_style")], "project_id string, reference_pack_id string, path string, role string")
    assert [(r.project_id, r.fault) for r in bundle.style_faults(packs, frame([("b", "s/1.jpg")], "project_id string, path string")).collect()] == [("a", "not_stable")]
    uses = frame([("a", "1", "k"), ("b", "1", "k")], "project_id string, page string, lock_id string")
    assert [(r.project_id, r.fault) for r in evidence.lock_faults(uses, uses.filter("project_id = 'b'"), uses).collect()] == [("a", "lock_unknown")]
    files = frame([("a", "f", "1"), ("b", "f", "2")], "project_id string, path string, sha string")
    assert evidence.hash_chain_faults(files, files, files).count() == 0
    reports = frame([("a", 1, "n", "r"), ("b", 1, "n", "r")], "project_id string, position long, name string, report_id string")
    assert evidence.batch_gate(reports.drop("report_id"), reports).count() == 0


def test_page_ids(spark):
    values = ["252（1）.jpg", "C:\\comic\\ Ａ12（2）.JPEG ", "252-1.jpg", "a/b/7.v2.png", "", None, "12", "（1）.jpg"]
    assert column(spark, values, page_id) == ["252(1)", "A12(2)", None, None, None, None, "12", None]


def test_digit_runs_of_any_length_sort_by_value(spark):
    names = ["1234567890123.jpg", "1234567890124.jpg", "123456789012345678901.jpg", "9.jpg", "10(2).jpg", "10.jpg", "0009.jpg", "a99999999999999b.jpg", "a100000000000000b.jpg", "a2.jpg"]
    keys = dict(zip(names, column(spark, names, natural_key)))
    assert sorted(names, key=lambda n: ordered(keys[n])) == ["0009.jpg", "9.jpg", "10.jpg", "10(2).jpg", "1234567890123.jpg", "1234567890124.jpg", "123456789012345678901.jpg", "a2.jpg", "a99999999999999b.jpg", "a100000000000000b.jpg"]


def test_page_ranges(spark):
    values = ["1", "9999", "10000", "0", "0000", "00012(3)", "12(x)", "x", "99999999999999999999999999999999999999999999", None]
    assert column(spark, values, page_in_range) == [True, True, False, False, False, True, False, False, False, None]


def test_candidate_names(spark):
    values = ["12_repaired", "12_1_visual_2", " １２_candidate ", "12(3)_x", "cover", "7_2"]
    assert column(spark, values, candidate_page) == ["12", "12(1)", "12", "12(3)", "cover", "7(2)"]


def test_paths_as_on_windows(spark):
    dice = random.Random(3)
    values = ["/".join(dice.choice(["a", "..", ".", "Ｂ", "ß", "", "c d"]) for _ in range(dice.randint(1, 6))).replace("/", dice.choice(["/", "\\"])) for _ in range(300)] + ["C:\\x\\..\\..\\y", "C:/", "/..", "//host/share/../z", " a ", "  ", ""]
    want = [ntpath.normpath(x).replace("\\", "/").casefold() if (x := unicodedata.normalize("NFKC", v).strip()) else None for v in values]
    made = column(spark, values, normal_path)
    assert [(v, m, w) for v, m, w in zip(values, made, want) if m != w and not v.startswith(("//", "\\\\"))] == []


def test_scene_keys_with_and_without_compatibility_forms(spark):
    df = spark.createDataFrame([("Ａ", "　x　", None, " ")], "chapter string, location string, story_time string, scene_id string")
    assert tuple(scene_keyed(df).first()) == ("A", "x", "unknown", "unknown")
    assert tuple(keyed(df).first()) == ("Ａ", "　x　", "unknown", "unknown")
