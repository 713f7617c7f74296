"""SentencePiece encoding and decoding with weighted finite-state transducers.

The normaliser (see normalisers), the pieces and the byte fallback are compiled
once. Composed with an input they give a lattice; its tropical shortest path is the
encoding. Two kinds of weights are known:

- unigram models: an arc costs its piece's negated score (ScoredPaths);
- byte-pair models: an arc costs 0 or infinity by whether it agrees with the piece
  before (PathFinder): sums of scores would not give this kind's encoding.

Code points that are no pieces fall back to the pieces of their bytes, or, in a
model without these, to one unknown piece for a run of them. A lattice of the
byte-pair kind breaks wherever no piece spans a border, so it is composed and
solved segment by segment, and solved segments are remembered in a bounded table.
Models with symbols defined by the user are refused.

Cases: a null text has null ids, and null ids decode to null; an empty text has
no ids, and no ids decode to an empty text. Any length, repeated rows and extra
columns are fine; an existing column of the output's name is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_paths import NEVER, MergeTable, PathFinder, ScoredPaths
from .common import Memo, map_arrow, with_fields
from .normalisers import MARK, Normaliser

UNIGRAM, BYTE_PAIR, USER_DEFINED = 1, 2, 4  # as the model file numbers them
KEEP, STATES = 350_000, 150_000  # segments, and pairs of pieces, remembered by each worker
SHORT = 40  # code points of a segment that is remembered


class PieceTable(MergeTable):
    def __init__(self, rank_of: dict[str, int]):
        last = max(rank_of.values())
        super().__init__(list, {p: r for p, r in rank_of.items() if len(p) > 1}, {MARK} | {p for p, r in rank_of.items() if len(p) > 1 and r == last})
        self.rank_of = rank_of

    def rank(self, a, b):
        return self.rank_of.get(a + b, NEVER)


class PieceTransducer:
    """Compiled from a model file on the driver; small, so it travels to the executors with the tasks."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BYTE_PAIR) or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("a unigram or byte-pair model without symbols of the user is needed")
        self.normaliser = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        norm = self.normaliser
        self.plain = not norm.rules and not norm.squeeze and norm.escape and not norm.suffix
        reader = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        n = reader.vocab_size()
        self.leading = norm.mark
        self.unknown = reader.unk_id()
        self.unknown_text = model.trainer_spec.unk_surface
        self.text_of = [reader.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
        self.id_of = {self.text_of[i]: i for i in plain}
        self.score = {self.text_of[i]: reader.get_score(i) for i in plain}
        self.byte_id = {int(self.text_of[i][3:5], 16): i for i in range(n) if reader.is_byte(i)}
        self.silent = {i for i in range(n) if reader.is_control(i)}
        if self.kind == BYTE_PAIR and any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("byte-pair pieces with an inner white space mark aren't supported")
        self._ready()

    def _ready(self):
        if self.kind == UNIGRAM:
            self.scored = ScoredPaths(self.score)
        else:
            self.finder = PathFinder(PieceTable({p: -int(x) for p, x in self.score.items()}), self.id_of, max(map(len, self.id_of)), STATES)
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.id_of.items()}
        self.alphabet = {p for p in self.id_of if len(p) == 1}
        self.memo = Memo(self._solve, KEEP, SHORT)
        apart = "".join(c for c in "\t\n\x0b\x0c\r" if c not in self.id_of and c not in "".join(self.id_of))  # no piece holds these
        self.segments = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+|[{apart}]" if apart else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.bytes_of = [t.replace(MARK, " ").encode() for t in self.text_of]
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        for i in self.silent:
            self.bytes_of[i] = b""
        self.bytes_of[self.unknown] = self.unknown_text.encode()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("finder", "scored", "memo", "segments", "bytes_of", "coded", "alphabet")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _fallen_back(self, chars: str) -> bytes:
        """The ids of a run of code points that are no pieces."""
        ids = [self.byte_id.get(b) for b in chars.encode()]
        return b"".join(i.to_bytes(4, "little") for i in (ids if None not in ids else [self.unknown]))

    def _scored_bytes(self, text: str) -> bytes:
        out, run = [], ""
        for piece, known in [*self.scored.path(text), ("", True)]:
            if not known:
                run += piece
                continue
            if run:
                out.append(self._fallen_back(run))
                run = ""
            if piece:
                out.append(self.coded[piece])
        return b"".join(out)

    def _solve(self, segment: str) -> bytes:
        """The ids of a segment as the bytes of int32."""
        coded = self.coded
        if self.alphabet.issuperset(segment):
            return b"".join([coded[p] for p in self.finder.path(segment)])
        out: list[bytes] = []
        for known, run in self._known_runs(segment):
            if known:
                out += [coded[p] for p in self.finder.path(run)]
            else:
                out.append(self._fallen_back(run))
        return b"".join(out)

    def _known_runs(self, segment):
        """Runs of code points that are pieces, and runs of others: these never merge, so paths end there."""
        at = 0
        while at < len(segment):
            known, end = segment[at] in self.id_of, at + 1
            while end < len(segment) and (segment[end] in self.id_of) == known:
                end += 1
            yield known, segment[at:end]
            at = end

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if self.plain:
            text = text.replace(" ", MARK)
            if self.leading:
                text = MARK + text
        elif not (text := self.normaliser(text)):
            return b""
        if self.kind == UNIGRAM:
            return self._scored_bytes(text)
        return b"".join(map(self.memo.__getitem__, self.segments(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer; ill-formed byte sequences become U+FFFD, and the leading mark goes."""
        get = self.bytes_of
        if self.normaliser.squeeze:  # blanks of pieces go as long as nothing else has come
            k, first = 0, b""
            while k < len(ids) and not first:
                first = get[ids[k]] if ids[k] == self.unknown or self.text_of[ids[k]] not in self.id_of else get[ids[k]].lstrip(b" ")
                k += 1
            return (first + b"".join([get[i] for i in ids[k:]])).decode(errors="replace")
        text = b"".join([get[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.leading and text[:1] == " " else text


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """docs with the piece ids of each whole text as array<int>; if decoded is named, also with what the ids decode to."""
    machine = docs.sparkSession.sparkContext.broadcast(PieceTransducer(model_file))  # bounded by the vocabulary
    docs = docs.drop(ids, *([decoded] if decoded else []))
    names, at = docs.columns, docs.columns.index(text)

    def run(frames):
        own = machine.value
        for frame in frames:
            parts = [None if t is None else own.encode_bytes(t) for t in frame.column(at).to_pylist()]
            ends = np.cumsum([0] + [0 if p is None else len(p) // 4 for p in parts])
            flat = pa.array(np.frombuffer(b"".join([p for p in parts if p]), dtype="<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([p is None for p in parts], pa.bool_()))
            more = [pa.array([None if p is None else own.decode(np.frombuffer(p, dtype="<i4").tolist()) for p in parts], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*frame.columns, lists, *more], names=[*names, ids, *([decoded] if decoded else [])])

    return map_arrow(docs, run, with_fields(docs.schema, **{ids: "array<int>"} | ({decoded: "string"} if decoded else {})))


def decode(docs: DataFrame, model_file: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """docs with the text that the piece ids spell."""
    machine = docs.sparkSession.sparkContext.broadcast(PieceTransducer(model_file))
    docs = docs.drop(text)
    names, at = docs.columns, docs.columns.index(ids)

    def run(frames):
        own = machine.value
        for frame in frames:
            lists = frame.column(at)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            valid = lists.is_valid().to_pylist()
            out = [own.decode(flat[ends[k] : ends[k + 1]].tolist()) if valid[k] else None for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, pa.string())], names=[*names, text])

    return map_arrow(docs, run, with_fields(docs.schema, **{text: "string"}))

