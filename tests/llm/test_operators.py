"""The operators against plain restatements, on a data folder and on rows chosen for trouble."""

import hashlib
import math
import random
import zlib

import brute
import pytest

from panelweave.llm import queries as q
from panelweave.llm import source_mix, weak_quality
from panelweave.llm.jaccard_join import join_components
from panelweave.llm.language_id import identify
from panelweave.llm.media_sequences import sequence_of
from panelweave.llm.piece_encoding import Normalizer, PieceEncoder, decode_pieces, encode_pieces, piece_digests
from panelweave.llm.pivot_topk import integers, top_k
from panelweave.llm.slot_sharding import shard_rows
from panelweave.llm.warc import archived

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, size string, slot string, spans string"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", "   \t\n", "one", "ONE", "one two three four five", BASE, BASE, BASE + " end", BASE.replace("w30", "x"), "é日本 ▁ 😀 \x00 a  b", "token=abc password: hunter22 AKIA" + "Q" * 16 + " " + "ab12" * 8, "api_key=token:abcdefgh", "word " * 40_000]
ROWS = [(i, t, "en" if i % 2 else "de", None if i % 5 == 0 else f"s{i % 3}", None, "t", "z", "y", "x") for i, t in enumerate(TEXTS)] + [(3, "one", None, "s1", None, "t", "z", "y", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_pieces(spark, odd, none):
    model = q.model_file()
    tool = PieceEncoder(model)
    for r in piece_digests(odd, model).collect():
        text = TEXTS[r.doc_id] or ""
        ids = tool.library.encode(text, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tool.library.decode(ids).encode()).hexdigest()
    encoded = encode_pieces(odd, model)
    for r in encoded.collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw
    assert {r.doc_id: r.text for r in decode_pieces(encoded, model).collect()}[6] == BASE
    assert piece_digests(none, model).count() == 0


def test_pieces_of_random_texts():
    tool, dice = PieceEncoder(q.model_file()), random.Random(5)
    for _ in range(3000):
        text = "".join(dice.choice(" ▁ ab\nthe\tée日😀\x00.,") for _ in range(dice.randint(0, 14)))
        ids = next(tool.encode([text]))
        assert ids.tolist() == tool.library.encode(text, add_eos=True)
        assert tool.decode(ids) == tool.library.decode(ids.tolist())


def test_normalisation_through_the_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    dice = random.Random(6)
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf")
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = Normalizer(model.normalizer_spec)
    for _ in range(800):
        text = "".join(dice.choice("Ａ（１） 　é́eÅ㍿ﬁßİ①a b\x07\r\n日") for _ in range(dice.randint(0, 12)))
        said, back = own.normalize(text)
        assert said.decode() == library.normalize(text) and len(back) == len(said) + 1


def test_components(spark, odd, none, docs):
    found = join_components(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    want = brute.jaccard_components([(r.doc_id, r.text) for r in docs.values()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    want = brute.jaccard_components(list(enumerate(TEXTS)))
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in join_components(odd).collect())
    assert join_components(none).count() == 0


def test_component_of_many_near_copies(spark):
    dice, rows = random.Random(3), []
    for i in range(400):
        words = BASE.split() * 2
        for _ in range(dice.randint(0, 6)):
            words[dice.randrange(len(words))] = f"e{dice.random()}"
        rows.append((i, " ".join(words)))
    found = join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard_components(rows)


def test_language(spark, none, docs):
    rows = identify(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert identify(none).count() == 0


def test_language_of_odd_rows(odd):
    rows = {r.doc_id: r for r in identify(odd).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows.values())


def test_mix(odd, none):
    rows = source_mix.mix(odd).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len(brute.WORDS.findall(TEXTS[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = brute.targets(sizes)
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) and abs(taken[s] - want[s]) < 1 for s in want)
    assert source_mix.mix(none).count() == 0


def test_archives(spark):
    pages = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "v\r\nx: y", None), (4, None, ""), (5, "w", "é" * 50_000), (6, "w", "b")]
    rows = archived(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.archive_rows([(i, h) for i, _, h in pages]))
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality(spark, odd, none):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = q.op8_weak_quality(spark, FOLDER).collect()
    right = [labels[r.doc_id] == r.accepted for r in rows if r.doc_id in labels]
    assert sum(right) >= 0.9 * len(right)
    assert len(weak_quality.classify(odd).collect()) == len(ROWS)
    assert weak_quality.classify(none).count() == 0


def test_shards(odd, none):
    rows = shard_rows(odd, 4).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in rows)
    assert shard_rows(none, 4).count() == 0


def test_shards_are_near_equal(spark):
    loads = [r["sum(size)"] for r in q.op9_slot_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()]
    assert len(loads) == 40 and max(loads) < 1.02 * min(loads)


def test_top_k(spark):
    dice = random.Random(1)
    vectors = [(i, [dice.gauss(0, 1) for _ in range(8)]) for i in range(350)] + [(400, None), (401, [None] * 8), (402, [math.nan] * 8), (500, [0.0] * 8)]
    df = integers(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3))
    exact = [(r.vec_id, r.v) for r in df.collect()]
    want = {(i, r + 1, j, -s) for i, v in exact if i % 100 == 0 for r, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in exact if j != i)[:10])}
    assert set(map(tuple, top_k(df.filter("vec_id % 100 = 0"), df).collect())) == want
    assert top_k(df.filter("vec_id < 0"), df).count() == 0


def test_top_k_of_many_blocks_holds_no_query_on_the_driver(spark, monkeypatch):
    dice = random.Random(2)
    vectors = [(i, [dice.gauss(0, 1) for _ in range(8 if i % 7 else 5)]) for i in range(300)] + [(7, [1.0] * 5)]
    df = integers(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3))
    exact = [(r.vec_id, r.v) for r in df.collect()]
    asked = df.filter("vec_id % 3 = 0")
    want = {(i, r + 1, j, -s) for i, v in exact if i % 3 == 0 for r, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in exact if j != i and len(w) == len(v))[:10])}
    monkeypatch.setattr(type(asked), "toLocalIterator", lambda *_, **__: pytest.fail("queries on the driver"))
    found = top_k(asked, df, block=16)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert set(map(tuple, found.collect())) == want


def test_a_grown_table_edits_the_stored_map(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(600)]
    more = rows + [(i, "y" * 300) for i in range(600, 640)]
    maps = f"{tmp_path}/maps"

    def sharded(data):
        found = shard_rows(spark.createDataFrame(data, "doc_id long, text string"), 4, slots=64, maps=maps).collect()
        return {r.virtual_slot: r.shard for r in found}, {r.map_version for r in found}, found

    first, version, _ = sharded(rows)
    assert version == {1} and sharded(rows)[:2] == (first, {1})
    second, version, found = sharded(more)
    assert version == {2} and {r.version for r in spark.read.parquet(maps).collect()} == {1, 2}
    loads = {s: sum(r["size"] for r in found if first[r.virtual_slot] == s) for s in range(4)}
    moved = {v for v in first if first[v] != second[v]}
    assert moved and all(loads[first[v]] > sum(loads.values()) / 4 for v in moved)


def test_captions_before_and_between_media():
    said = lambda html: [(x["kind"], x["text"], x["caption"]) for x in sequence_of(html)]
    assert said("<figure><figcaption>cap</figcaption><img src='a'></figure><img src='b' alt='q'>") == [("media", "a", "cap"), ("media", "b", "q")]
    assert said("<figure><img src='a'><figcaption>cap</figcaption><img src='b'></figure>") == [("media", "a", "cap"), ("media", "b", "cap")]
    assert said("<figure><figcaption>cap</figcaption><img src='a'>") == [("media", "a", "cap")]
    assert said("<figure><figcaption>cap</figcaption></figure>end") == [("text", "cap end", None)]
