"""The secret ledger over several runs, against a plain restatement and on rows chosen for trouble."""

import hashlib
import re
import uuid

import brute

from panelweave.llm import secret_ledger as s
from panelweave.llm._spark import shared_folder

SCHEMA = "doc_id long, text string, blob_id string, spans string, path int, body int"
HEX = "0123456789abcdef" * 2
TEXTS = {1: f"token=abcdef1 and {HEX}", 2: "nothing here", 3: None, 4: "", 5: "AKIA" + "Q" * 16 + " password: 'hunter22'", 6: f"é日 secret = {HEX}", 7: f"0{HEX}apikey=zzzzzz9", 8: "key=short token=abc", 9: "token=abcdef2 " * 3_000}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def new_folder(spark):
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def said(df, key="doc_id"):
    return sorted(((r[key], ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.spans)) for r in df.collect()), key=repr)


def plain(rows):
    return sorted(((i, brute.secrets(t)) for i, t in rows), key=repr)


def test_report(spark):
    rows = [*TEXTS.items(), (1, TEXTS[1]), (None, TEXTS[1]), (None, TEXTS[5])]
    found = s.secret_report(table(spark, rows), new_folder(spark)).collect()
    assert sorted(((r.doc_id, r.spans) for r in found), key=repr) == plain(rows)
    for r in found:
        kinds = [x.split(":")[0] for x in r.spans.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert s.secret_report(table(spark, []), new_folder(spark)).count() == 0


def test_runs_scan_only_pairs_that_the_ledger_lacks(spark, monkeypatch):
    folder, scanned, blobs = new_folder(spark), s.scanned, []
    monkeypatch.setattr(s, "scanned", lambda unseen, rules=s.RULES: blobs.append(sorted((r.body, tuple(r.todo)) for r in unseen.collect())) or scanned(unseen, rules))
    all_rules = ("assign@1", "access@1", "hex@1")
    first = [(i, TEXTS[i]) for i in (1, 2, 3)]
    assert said(s.scan(table(spark, first), "doc_id", "text", folder)) == plain(first)
    # a later version of path 2, a path with a known text, and a path that is gone
    second = [(1, TEXTS[1]), (2, TEXTS[5]), (8, TEXTS[1])]
    assert said(s.scan(table(spark, second), "doc_id", "text", folder)) == plain(second)
    assert said(s.scan(table(spark, second), "doc_id", "text", folder)) == plain(second)
    assert blobs == [sorted((t or "", all_rules) for _, t in first), [(TEXTS[5], all_rules)]]
    ever = [*first, *second]
    assert sorted(set(said(s.exposed(spark, folder), "path"))) == sorted({x for x in plain(ever) if x[1]})
    assert s.stored(spark, folder, "versions").count() == len(set(ever))


def test_a_new_rule_version_scans_every_blob_under_that_rule_alone(spark, monkeypatch):
    folder, rows = new_folder(spark), list(TEXTS.items())
    s.scan(table(spark, rows), "doc_id", "text", folder).count()
    changed = (*s.RULES[:2], ("hex", 2, r"[0-9a-f]{8,}", 0, 8))
    todo, scanned = [], s.scanned
    monkeypatch.setattr(s, "scanned", lambda unseen, rules=s.RULES: todo.extend(r.todo for r in unseen.collect()) or scanned(unseen, rules))
    found = dict(said(s.scan(table(spark, rows), "doc_id", "text", folder, changed)))
    assert todo == [["hex@2"]] * (len(rows) - 1)  # null and the empty text are one blob
    for i, t in rows:
        want = [(int(x.split(":")[1]), k, x) for x in brute.secrets(t).split(",") if x for k in [("assign", "access").index(x.split(":")[0])] if not x.startswith("hex")] if not (t and HEX in t) else None
        if want is None:
            assert sum(x.startswith("hex:") for x in found[i].split(",")) == len(re.findall("[0-9a-f]{8,}", t))
        else:
            assert [x for x in found[i].split(",") if x and not x.startswith("hex")] == [x for *_, x in sorted(want)]
    # the rules of before still have their findings, and nothing is scanned for them
    todo.clear()
    assert said(s.scan(table(spark, rows), "doc_id", "text", folder)) == plain(rows) and not todo


def test_one_blob_on_very_many_paths_and_very_many_hits(spark):
    rows = [(i, TEXTS[5]) for i in range(3000)] + [(5000, f"{HEX} token=abcdef{3} " * 20_000)]
    assert said(s.scan(table(spark, rows), "doc_id", "text", new_folder(spark))) == plain(rows)


def test_redaction_merges_overlaps(spark):
    folder = new_folder(spark)
    df = table(spark, TEXTS.items())
    found = s.scan(df, "doc_id", "text", folder).withColumnRenamed("doc_id", "of")
    clear = s.clear_stretches(found.select("blob_id", "spans").distinct())
    done = df.select("doc_id", "text").join(found.join(clear, "blob_id").select("of", "clear"), df["doc_id"] == found["of"]).select("doc_id", s.redacted(df["text"], clear["clear"]).alias("text"))
    for r in done.collect():
        want, at = "", 0
        for x in brute.secrets(TEXTS[r.doc_id]).split(","):
            start, end = map(int, x.split(":")[1:])
            if start >= at:
                want += TEXTS[r.doc_id][at:start] + "[REDACTED]"
            at = max(at, end)
        assert r.text == want + TEXTS[r.doc_id][at:]


def test_a_first_write_that_failed_leaves_no_ledger(spark, tmp_path):
    for name in ("versions", "ledger"):
        (tmp_path / name / "_temporary").mkdir(parents=True)
    rows = list(TEXTS.items())
    for _ in range(2):
        assert said(s.scan(table(spark, rows), "doc_id", "text", f"{tmp_path}")) == plain(rows)


def test_a_pair_that_stands_twice_in_the_ledger_counts_once(spark):
    folder, rows = new_folder(spark), list(TEXTS.items())
    s.scan(table(spark, rows), "doc_id", "text", folder).count()
    spark.createDataFrame(s.stored(spark, folder, "ledger").collect(), s.stored(spark, folder, "ledger").schema).write.mode("append").parquet(f"{folder}/ledger")
    assert said(s.scan(table(spark, rows), "doc_id", "text", folder)) == plain(rows)
    assert said(s.exposed(spark, folder), "path") == [x for x in plain(rows) if x[1]]
