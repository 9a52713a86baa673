"""WARC archives against a plain restatement, on rows chosen for trouble, and the parts of the format."""

import random

import brute
import zstandard

from panelweave.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, original long, frame string"


def table(spark, pages):
    return spark.createDataFrame([(*p, "x", 5, "y") for p in pages], SCHEMA).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(pages, least=0):
    held = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= least:
            held.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages:
        ids = held.get(h or "", [])
        top = max((x for x in ids if x is not None), default=None)
        revisit = len(ids) > 1 and top is not None and i != top
        size, digest = brute.archive_rows([(0, h)])[0][1:3]
        out.append((i, size, digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


PAGES = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "v\r\nx: y", None), (4, None, ""), (None, "n", ""), (None, "n", "alone"), (None, "n", "both"), (None, "n", "both"), (5, "w", "é" * 400_000), (6, "w", "b"), (6, "w", "c"), (7, "w", "c"), (8, "w", "\r\n\r\nWARC/1.1\r\n"), (9, "w", "{}".format("x" * 50))]


def test_odd_pages(spark):
    assert rows(warc.archived(table(spark, PAGES))) == plain(PAGES)


def test_small_payloads_are_all_responses(spark):
    assert rows(warc.archived(table(spark, PAGES), least=5)) == plain(PAGES, least=5)


def test_many_copies_of_one_page(spark):
    pages = [(i, f"u{i}", "<p>the same</p>" if i % 3 else f"<p>own {i}</p>") for i in range(900)]
    assert rows(warc.archived(table(spark, pages))) == plain(pages)


def test_empty_table(spark):
    assert warc.archived(table(spark, [])).count() == 0


def test_the_stream_is_a_dictionary_frame_and_a_frame_a_record(spark, tmp_path):
    pages = [(i, f"u{i}", f"<html><body><h1>Title {i}</h1>" + "<p>Some words that recur on every page of the site.</p>" * 20 + f"{i * 7919}</body></html>") for i in range(300)]
    path = f"file://{tmp_path}/archive"
    warc.write_archives(table(spark, pages).coalesce(1), path)
    stream = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).first()["content"])
    assert stream.startswith(warc.DICTIONARY_MAGIC)
    size = int.from_bytes(stream[4:8], "little")
    content, rest, frames = stream[8 : 8 + size], stream[8 + size :], 0
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    while rest:
        if rest.startswith(warc.SEPARATOR.encode()):
            rest = rest[8:]
            continue
        one = tool.decompressobj()
        said = one.decompress(rest)
        assert said.startswith(b"WARC/1.1\r\n") and said.count(b"WARC-Record-ID") == 1
        frames, rest = frames + 1, one.unused_data
    assert frames == 300 and zstandard.ZstdCompressionDict(content).dict_id() > 0


def test_long_records_are_in_the_sample(spark):
    dice = random.Random(8)
    pages = [(i, f"u{i}", " ".join(str(dice.random()) + (" needle in every long page" if j % 20 == 0 else "") for j in range(4_000))) for i in range(20)]
    assert b"needle" in warc.build_dictionary(table(spark, pages))


def test_few_records_are_the_dictionary_themselves():
    assert warc.dictionary_of([b"only one"]) == b"only one" and warc.dictionary_of([])
