"""The stages of the pipeline against plain restatements, with null and repeated ids."""

from collections import Counter

import brute
import pytest

import corpus_pipeline as cp
from panelweave.llm.queries import model_file
from panelweave.llm.piece_encoding import piece_digests

BASE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))
SECRET = "the door opens with password: hunter22 and nothing else " + " ".join(f"u{i}" for i in range(30))
TEXTS = [(5, BASE), (7, BASE + " end"), (None, BASE + " tail"), (9, OTHER), (9, SECRET), (9, OTHER + " end"), (9, "short words"), (None, "no id and no copy"), (None, "no id and no copy"), (None, "no id and\tno COPY"), (None, SECRET.replace("hunter22", "hunter23x")), (None, None), (None, None), (None, " "), (3, None), (3, None), (3, ""), (2, ""), (11, "AKIA" + "Q" * 16), (11, "AKIA" + "Q" * 16), (12, OTHER.upper())]
ROWS = [(i, t, "en", f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return Counter(map(tuple, df.select(*cp.COLUMNS).collect()))


def order(row):
    return tuple((x is not None, x) if x is not None else (False,) for x in row)


def kept(rows):
    """distinct, plainly: a row for each group of linked texts, by id (null last)."""
    held = {}
    for r in rows:
        key = (r[0], r[1])
        if brute.shingles(r[1]) or r[0] is not None:
            held[key] = min(held.get(key, r), r, key=order)
    names = list(held)
    roots = brute.jaccard_components([(n, k[1]) for n, k in enumerate(names)])
    ids, groups = {}, Counter()
    for n, k in enumerate(names):
        ids.setdefault(roots[n][1], set()).add(k)
    for group in ids.values():
        groups[frozenset(group)] += 1
    blank = Counter(r for r in rows if r[0] is None and not brute.shingles(r[1]))
    return held, groups, blank


def check_distinct(rows, found):
    held, groups, blank = kept(rows)
    assert sum(found.values()) == len(groups) + sum(blank.values())
    for r, n in blank.items():
        assert found[r] == n
    left = [r for r in (found - blank).elements()]
    for group in groups:
        mine = [r for r in left if (r[0], r[1]) in group]
        assert len(mine) == 1 and mine[0] == held[mine[0][:2]]
        ids = [i for i, _ in group if i is not None]
        assert mine[0][0] == (min(ids) if ids else None)


def redact(text):
    if text is None or not brute.secrets(text):
        return text
    out, at = "", 0
    for kind, start, end in (x.split(":") for x in brute.secrets(text).split(",")):
        if int(start) >= at:
            out += text[at : int(start)] + "[REDACTED]"
        at = max(at, int(end))
    return out + text[at:]


def redacted_rows(rows):
    return Counter((i, redact(t), lang, s, n if redact(t) == t else len(redact(t))) for i, t, lang, s, n in rows)


def check_mixed(docs, rows, found):
    sizes, words = Counter(), lambda t: len(brute.WORDS.findall(t or ""))
    for r in rows:
        sizes[r[3]] += words(r[1])
    assert set(found) <= set(rows)
    want = brute.targets(sizes)
    for s in sizes:
        mine = [(r, n) for r, n in found.items() if r[3] == s]
        most = max(words(r[1]) for r in rows if r[3] == s)
        assert abs(sum(n * words(r[1]) for r, n in mine) - want[s]) <= most
        whole = int(want[s] // sizes[s])
        copies = Counter(r for r in rows if r[3] == s and words(r[1]))
        assert all(n * whole <= found[r] <= n * (whole + 1) for r, n in copies.items())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_quality_keeps_rows_whatever_their_id(spark, docs):
    from panelweave.llm.weak_quality import classify, fit

    by_text = {r.text: r.accepted for r in cp.score(docs, fit(docs), keep=cp.COLUMNS).collect()}
    assert classify(docs).count() == len(ROWS)
    assert rows_of(cp.quality(spark, docs, "")) == Counter(r for r in ROWS if by_text[r[1]])


def test_distinct(spark, docs):
    check_distinct(ROWS, rows_of(cp.distinct(spark, docs, "")))


def test_secrets_of_rows_without_an_id(spark, docs):
    assert rows_of(cp.without_secrets(spark, docs, "")) == redacted_rows(ROWS)


def test_mixed(spark, docs):
    check_mixed(docs, ROWS, rows_of(cp.mixed(spark, docs, "")))


def test_encoded(spark, docs):
    assert cp.encoded(spark, docs, "").count() == len(ROWS)


def test_run(spark, docs, tmp_path):
    many = ROWS + [(i, BASE if i % 3 else f"{OTHER} {i} {i + 1} {i + 2}", "en", "s0", 1) for i in range(100, 140)]
    spark.createDataFrame(many, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    stage, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, f in cp.STAGES[:4]:
        f(spark, stage, "").write.parquet(f"{tmp_path}/{len(out)}")
        stage = spark.read.parquet(f"{tmp_path}/{len(out)}")
        out.append(list(rows_of(stage).elements()))
    check_distinct(out[0], Counter(out[1]))
    assert Counter(out[2]) == redacted_rows(out[1])
    check_mixed(stage, out[2], Counter(out[3]))
    want = Counter(map(tuple, piece_digests(stage, model_file()).collect()))
    assert Counter(map(tuple, cp.run(spark, str(tmp_path)).collect())) == want


def test_long_near_copies_of_one_id_leave_one_row(spark):
    long = [f"x{i}" for i in range(300)]
    near = [*long[:150], "changed", *long[151:]]
    rows = [(7, " ".join(long), "en", "s", 1), (7, " ".join(near), "en", "s", 1), (7, " ".join(f"y{i}" for i in range(300)), "en", "s", 1)]
    assert cp.distinct(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").count() == 2
    assert cp.distinct(spark, spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA), "").count() == 2
