"""Encoding through a compiled character map, its byte spans, and rows chosen for trouble, against the library."""

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from panelweave.llm import queries as q
from panelweave.llm.piece_encoding import PieceEncoder, decode_pieces, encode_pieces, piece_digests

SCHEMA = "doc_id long, text string, ids string, n_tokens int, starts string"
ALPHABET = "Ａ（１） 　é́eÅ㍿ﬁßİ①a b\x07\r\n日😀the cat ▁"


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The 32k model with another normaliser: a compiled map, white space trimmed, no prefix."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(q.model_file(), "rb").read())
    other = sentencepiece_model_pb2.ModelProto()
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
    model.normalizer_spec.CopyFrom(other.normalizer_spec)
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def random_texts(n, seed=2):
    dice = random.Random(seed)
    return ["".join(dice.choice(ALPHABET) for _ in range(dice.randint(0, 25))) for _ in range(n)]


def test_ids_and_spans_through_the_map(mapped):
    tool = PieceEncoder(mapped)
    assert not tool.by_unit and tool.normalizer.map.units
    seen = 0
    for text in random_texts(1500):
        ids = next(tool.encode([text]))
        assert ids.tolist() == tool.library.encode(text, add_eos=True)
        assert tool.decode(ids) == tool.library.decode(ids.tolist())
        starts, ends = tool.spans(text, ids)
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(starts, ends)) and all(b <= a for b, a in zip(starts, starts[1:]))
        proto = tool.library.encode(text, return_type="proto").pieces
        for p, i, a, b in zip(proto, ids, starts, ends):
            assert p.id == i
            if not p.piece.startswith("<0x"):
                # the library counts in characters, the spans are bytes; it may leave trimmed space to a neighbour
                assert raw[a:b].decode(errors="replace").strip() == p.surface.strip()
                seen += 1
    assert seen > 3000


def test_spans_project_every_piece_to_its_source():
    tool = PieceEncoder(q.model_file())
    for text in random_texts(800, 3):
        ids, raw = next(tool.encode([text])), text.encode()
        starts, ends = tool.spans(text, ids)
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
        for i, a, b in zip(ids.tolist(), starts, ends):
            if i != tool.end:
                assert tool.bytes[i].replace("▁".encode(), b" ").lstrip(b" ") == raw[a:b].replace("▁".encode(), b" ").lstrip(b" ")


def test_rows(spark):
    texts = [None, "", " ", "one", "ONE one", "x" * 300_000, "é日 " * 50_000]
    rows = [*enumerate(texts), (None, "one"), (None, None), (3, "one"), (3, "other")]
    df = spark.createDataFrame([(i, t, "i", 1, "s") for i, t in rows], SCHEMA).repartition(3)
    tool = PieceEncoder(q.model_file())
    want = []
    for i, t in rows:
        ids = tool.library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tool.library.decode(ids).encode()).hexdigest()))
    found = [tuple(r)[:4] for r in piece_digests(df, q.model_file()).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    back = decode_pieces(encode_pieces(df, q.model_file()), q.model_file())
    assert sorted(r.text for r in back.collect()) == sorted(tool.library.decode(tool.library.encode(t or "", add_eos=True)) for _, t in rows)
    assert piece_digests(df.filter("false"), q.model_file()).count() == 0
