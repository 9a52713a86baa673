"""Media sequences against plain restatements: stored bytes, features, and pages with several items."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from panelweave.llm import media_sequences as m

SCHEMA = "doc_id long, text string, digest string, html string, position int, said string"
TEXTS = [None, "", "   \t\n", "one", "first line\nsecond & <third>\nend", "é日本 😀 \x00 a  b", "x" * 64, "y" * 65, "long " * 60_000, "<img src='media:0'> & </p>"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "d", "h", 1, "s") for i, t in rows], SCHEMA).repartition(3)


def feature(text):
    raw = (text or "").encode()
    p = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
    bands = [sum(b // 16 == k for b in p) for k in range(16)]
    return f"64x{len(p) // 64};mean={round(sum(p) / len(p), 4)};bands=" + ",".join(map(str, bands))


def test_documents(spark):
    rows = [*enumerate(TEXTS), (3, "one"), (None, "one"), (None, None), (77, TEXTS[4])]
    found = m.document_media(table(spark, rows)).collect()
    assert len(found) == len(rows)
    values = {}
    left = sorted(rows, key=repr)
    for r in found:
        text = next(t for i, t in left if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        left.remove((r.doc_id, text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == brute.media_row(text)
        assert r.feature == feature(text) and r.caption == f"{r.n_bytes} bytes of text"
        lines = (text or "").split("\n", 1)
        before = 1 if lines[0].split() else 0
        assert r.position == before and r.n_items == before + 1 + bool(lines[1:] and lines[1].split())
        assert r.words_sha256 == hashlib.sha256(" ".join((text or "").split()).encode()).hexdigest()
        # equal texts give equal values, whatever the id
        assert values.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:]
    assert not left
    assert m.document_media(table(spark, [])).count() == 0


def test_stored_bytes_are_read_back(spark):
    store = m.store_media(table(spark, list(enumerate(TEXTS)) + [(9, "one")]).coalesce(1), "text")
    kept = {r.digest: bytes(r.medium) for r in store.collect()}
    assert len(kept) == store.count() == len({t or "" for t in TEXTS})
    for t in TEXTS:
        medium = m.medium_of(t)
        assert kept[hashlib.sha256(medium).hexdigest()] == medium and m.samples(medium).startswith((t or "").encode())
    with pytest.raises(ValueError):
        m.samples(m.medium_of("x")[:-1])


def test_pages_with_several_items_resolve_to_payloads(spark):
    """Order, captions and payloads of sequences made of real pages and media of their own."""
    media = [f"payload {k} " * (k + 1) for k in range(5)]
    digests = [hashlib.sha256(m.medium_of(t)).hexdigest() for t in media]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(40).collect()
    rows, want = [], []
    for n, page in enumerate(pages):
        html, expected = page.html or "", 0
        for j in range(n % 4):
            k = (n + j) % 6
            digest = digests[k] if k < 5 else "0" * 64  # the last names no medium
            html = f"<figure><figcaption>c{n}.{j}</figcaption><img src='media:{digest}'></figure>" + html if j % 2 else html + f"<p>t{j}</p><img alt='c{n}.{j}' src='media:{digest}'>"
            want.append((page.page_id, f"c{n}.{j}", media[k] if k < 5 else None))
        rows.append((page.page_id, html))
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    parsed = m.parse_sequences(df, "html", ["page_id"])
    for r in parsed.collect():
        assert [x.position for x in r["items"]] == list(range(len(r["items"])))
        assert not any(a.kind == b.kind == "text" for a, b in zip(r["items"], r["items"][1:]))
    store = m.store_media(spark.createDataFrame([(t,) for t in media], "text string"), "text")
    refs = parsed.select("page_id", F.explode("items").alias("x")).select("page_id", "x.*").filter("kind = 'media' and caption like 'c%.%' and digest is not null")
    found = [(r.page_id, r.caption, None if r.medium is None else m.samples(bytes(r.medium)).rstrip(b"\x00").decode()) for r in m.resolve(refs, store).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_items_of_html():
    items = m.sequence_of("<p>a &amp; b<img src='media:x' alt='q'>c</p><script>no</script><figure><img src='u'><figcaption>cap</figcaption></figure>")
    assert [(x["position"], x["kind"], x["digest"], x["caption"]) for x in items] == [(0, "text", None, None), (1, "media", "x", "q"), (2, "text", None, None), (3, "media", None, "cap")]
