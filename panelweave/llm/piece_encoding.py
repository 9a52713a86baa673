"""SentencePiece encoding that keeps source offsets, and decoding.

Text is normalised by longest-prefix replacement through the model's compiled character
map. Each normalised byte remembers the source byte that it came from, so every piece of
the result can be projected to a byte span of the source. Pieces come from the
sentencepiece library. Where no piece of the vocabulary has a space mark after another
character, merges never cross the start of a space run; the text is then cut there and each
distinct unit is encoded once per worker (a bounded memo), which gives the same ids.

Defined results: null or empty text has no piece but the end id; very long texts are
encoded whole; repeated rows give equal values. Null and repeated ids are carried along as
they are; extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
# fixed values: type numbers of the model format
CONTROL_PIECE, BYTE_PIECE = 3, 6
MEMO_UNITS = 400_000
MEMO_CHARS = 48


class CharacterMap:
    """A compiled character map: a double-array trie of prefixes and the replacements they lead to."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.heads: frozenset[int] = frozenset()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.texts = blob[4 + size :]
            self.heads = frozenset(c for c in range(256) if self._step(self._base(0, 0), c) is not None)

    def _base(self, node: int, unit_at: int) -> int:
        unit = self.units[unit_at]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, node: int, c: int) -> int | None:
        at = node ^ c
        return at if at < len(self.units) and self.units[at] & 0x800000FF == c else None

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix of text[at:] and that prefix's length."""
        best, node = None, self._base(0, 0)
        for length in range(1, len(text) - at + 1):
            here = self._step(node, text[at + length - 1])
            if here is None:
                break
            node = self._base(here, here)
            if self.units[here] & 0x100:
                best = (self.units[node] & 0x7FFFFFFF, length)
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(0, best[0])], best[1]


class Normalizer:
    """Longest-prefix normalisation with the source offset of each byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK.encode() if spec.escape_whitespaces else b" "
        self.plain = not self.map.units and not self.trim

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end its offset in the UTF-8 source."""
        source = text.encode("utf-8")
        if not source:
            return b"", np.zeros(1, dtype=np.int64)
        if self.plain:
            codes = np.frombuffer(source, dtype=np.uint8)
            back = np.repeat(np.arange(len(codes)), np.where(codes == 32, len(self.space), 1))
            head = self.space if self.prefix else b""
            return head + source.replace(b" ", self.space), np.concatenate([np.zeros(len(head), dtype=np.int64), back, [len(codes)]])
        out, back, at = bytearray(), [], 0
        if self.trim:
            while at < len(source) and (piece := self._piece(source, at))[0] == b" ":
                at += piece[1]
            if at == len(source):
                return b"", np.array([at])
        if self.prefix:
            out += self.space
            back += [at] * len(self.space)
        was_space = self.trim
        while at < len(source):
            made, used = self._piece(source, at)
            if was_space:
                made = made.lstrip(b" ")
            if made:
                was_space = self.trim and made.endswith(b" ")
                made = made.replace(b" ", self.space)
                out += made
                back += [at] * len(made)
            at += used
        if self.trim:
            while out.endswith(self.space):
                at = back[len(out) - len(self.space)]
                del out[-len(self.space) :], back[-len(self.space) :]
        return bytes(out), np.array([*back, at], dtype=np.int64)

    def _piece(self, source: bytes, at: int) -> tuple[bytes, int]:
        first = source[at]
        if first in self.map.heads and (found := self.map.longest(source, at)):
            return found
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return source[at : at + width], width


class PieceEncoder:
    """Ids and source byte spans of texts under one model."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        self.normalizer = Normalizer(model.normalizer_spec)
        self.lengths = np.array([1 if p.type == BYTE_PIECE else len(p.piece.encode()) for p in model.pieces])
        self.end = self.library.eos_id()
        self.lengths[self.end] = 0
        cut = model.normalizer_spec
        self.by_unit = self.normalizer.plain and cut.add_dummy_prefix and cut.escape_whitespaces and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces) and model.trainer_spec.byte_fallback
        self.decimals = np.array([f"{i} " for i in range(len(self.lengths))], dtype="S").view(np.uint8).reshape(len(self.lengths), -1)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE_PIECE else b"" if p.type == CONTROL_PIECE else p.piece.encode() for p in model.pieces]
        self.unknown = self.library.unk_id()
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        if not self.by_unit:
            for ids in self.library.encode(texts, add_eos=True, num_threads=1):
                yield np.array(ids, dtype=np.int64)
            return
        split = [self._split(t) for t in texts]
        if len(self.memo) > MEMO_UNITS:
            self._forget()
        new = [u for u in set().union(*split) if u not in self.memo]
        self._learn(new)
        firsts = np.cumsum(self.counts) - self.counts
        for units in split:
            numbers = np.fromiter(map(self.memo.__getitem__, units), dtype=np.int64, count=len(units))
            counts = self.counts[numbers]
            total = int(counts.sum())
            at = np.repeat(firsts[numbers] - (np.cumsum(counts) - counts), counts) + np.arange(total)
            yield np.append(self.flat[at], self.end)
        if any(len(u) > MEMO_CHARS for u in new):
            self._forget()

    def _split(self, text: str) -> list[str]:
        """The units of a text, each without the mark that stands first in it."""
        if not text:
            return []
        if MARK not in text and "" not in (units := text.split(" ")):
            return units
        return [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def _learn(self, units: list[str]) -> None:
        """Units are encoded end to end in runs, and the ids dealt back by length; units of marks alone go one by one."""
        solid = [u for u in units if u.strip(MARK)]
        found, sizes = [self.flat], [self.counts]
        for a in range(0, len(solid), 512):
            run = solid[a : a + 512]
            ids = np.array(self.library.encode(MARK.join(run), num_threads=1), dtype=np.int64)
            ends = np.cumsum([len(u.encode()) + len(MARK.encode()) for u in run])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            found.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        for u in (marks := [u for u in units if not u.strip(MARK)]):
            ids = self.library.encode(u, num_threads=1) if u else [self.library.piece_to_id(MARK)]
            found.append(np.array(ids, dtype=np.int64))
            sizes.append(np.array([len(ids)]))
        for u in (*solid, *marks):
            self.memo[u] = len(self.memo)
        self.flat, self.counts = np.concatenate(found), np.concatenate(sizes)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal with one space between."""
        digits = self.decimals[ids].ravel()
        return digits[digits != 0].tobytes()[:-1]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of each piece in the UTF-8 bytes of the source; the end id has an empty span at the end."""
        _, back = self.normalizer.normalize(text)
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate([[0], ends[:-1]])
        return back[starts], back[ends]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes; it is asked itself where ids hold an unknown or bytes that are no text."""
        ids = ids.tolist()
        if self.by_unit and self.unknown not in ids:
            said = b"".join(map(self.bytes.__getitem__, ids)).replace(MARK.encode(), b" ")
            try:
                return said[said.startswith(b" ") :].decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids)


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    """One encoder per worker process and model."""
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def encode_pieces(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, and the source byte span (starts, ends) of each id."""

    def work(batches):
        tool = encoder(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, (t, ids) in enumerate(zip(texts, tool.encode(texts))):
                starts, ends = tool.spans(t, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))], names=[key, "ids", "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, ids array<int>, starts array<bigint>, ends array<bigint>")


def decode_pieces(encoded: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text that the ids stand for (null ids: null)."""

    def work(batches):
        tool = encoder(model_file)
        for batch in batches:
            texts = [None if x is None else tool.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(work, f"{key} {kind}, text string")


def piece_digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of encoding, spans and decoding in one pass; nothing of a text but its digests leaves the worker."""

    def work(batches):
        tool = encoder(model_file)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, id_sums, span_sums, text_sums = [], [], [], []
                for t, ids in zip(texts, tool.encode(texts)):
                    counts.append(len(ids))
                    id_sums.append(hashlib.sha256(tool.decimal(ids)).hexdigest())
                    starts, ends = tool.spans(t, ids)
                    span_sums.append(hashlib.sha256(np.concatenate([starts, ends]).astype("<i4").tobytes()).hexdigest())
                    text_sums.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string()), pa.array(span_sums, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
