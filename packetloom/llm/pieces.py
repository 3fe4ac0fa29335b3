"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import as_bytes, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # fixed value: the mark for a blank in a piece
UNKNOWN_GAP = 10.0  # fixed value: an uncovered character scores this much below the lowest piece
CACHE = 200_000
_ROWS = 256


@dataclass
class Vocabulary:
    """Pieces with id and score, the ids of the 256 byte pieces, and the bytes each id stands for."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown_score: float
    text: list[bytes]


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces and scores of a model file with byte pieces; read once, by the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, text = {}, [0] * 256, []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            text.append(b"")
        else:
            pieces[piece] = (k, model.get_score(k))
            text.append(piece.replace(SPACE, " ").encode())
    if not any(byte_ids):
        raise ValueError(f"{path} has no byte pieces, so texts could not be restored")
    usual = [s for _, s in pieces.values() if s > -1e8]
    return Vocabulary(pieces, byte_ids, min(usual) - UNKNOWN_GAP, text)


class _Chunks(dict):
    """Packed ids by chunk; a short chunk met for the first time is encoded and kept.

    A full cache becomes the older half, from which chunks met again are taken back.
    """

    def __init__(self, viterbi):
        super().__init__()
        self.viterbi, self.older = viterbi, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("i", self.viterbi(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes and decodes texts; built once in each worker from the broadcast vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (k, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, k))
        self.automaton.make_automaton()
        # No piece may reach over a cut: a mark after another character, or either side of a line feed.
        inside = any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces)
        line = any("\n" in p and len(p) > 1 for p in vocabulary.pieces)
        self.cut = None if inside or line else re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.known = _Chunks(self.viterbi)
        self.singles = frozenset(p for p in vocabulary.pieces if len(p) == 1)

    def viterbi(self, text: str, literal: frozenset[int] = frozenset()) -> list[int]:
        """Ids of the best-scoring split; of equal splits, the one whose last piece is longer.

        The automaton yields every piece that ends at a character by following its output links;
        each relaxes the best score there. A character that is no piece, and one whose place is in
        ``literal``, costs the unknown score and becomes its UTF-8 bytes.
        """
        if not literal and self.singles.issuperset(text):
            return self._covered(text)
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        pieces, unknown = self.vocabulary.pieces, self.vocabulary.unknown_score
        settled = 0

        def settle(until: int) -> None:
            nonlocal settled
            for p in range(settled + 1, until + 1):
                if text[p - 1] not in pieces or p - 1 in literal:
                    score = best[p - 1] + unknown
                    if score > best[p]:
                        best[p], back[p] = score, (1, -1)
            settled = max(settled, until)

        for last, (length, score, k) in self.automaton.iter(text):
            end = last + 1
            begin = end - length
            if settled < begin:
                settle(begin)
            if literal and any(p in literal for p in range(begin, end)):
                continue
            score += best[begin]
            if score > best[end]:
                best[end], back[end] = score, (length, k)
        settle(n)
        found, at = [], n
        while at:
            length, k = back[at]
            if k < 0:
                found.extend(self.vocabulary.byte_ids[b] for b in reversed(text[at - 1].encode()))
            else:
                found.append(k)
            at -= length
        return found[::-1]

    def _covered(self, text: str) -> list[int]:
        """The same for a text whose every character is a piece: all places are reached, none is unknown."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list = [None] * (n + 1)
        for last, piece in self.automaton.iter(text):
            end = last + 1
            score = piece[1] + best[end - piece[0]]
            if score > best[end]:
                best[end], back[end] = score, piece
        found, at = [], n
        while at:
            length, _, k = back[at]
            found.append(k)
            at -= length
        return found[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a leading mark is added and blanks become marks. An empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        if SPACE in text:  # a mark that the text itself holds must not come back as a blank
            literal = frozenset(k + 1 for k, c in enumerate(text) if c == SPACE)
            return np.array(self.viterbi(SPACE + text.replace(" ", SPACE), literal), np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        if self.cut is None:
            return np.array(self.viterbi(marked), np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.cut.findall(marked))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of the ids, without the leading blank."""
        return b"".join(map(self.vocabulary.text.__getitem__, ids.tolist()))[1:]


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.value is not None and id(shared.value) not in _encoders:
        _encoders.clear()
        _encoders[id(shared.value)] = Encoder(shared.value)
    return _encoders[id(shared.value)]


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carry columns, ids, n_tokens, round_trip) of every row; ``round_trip``: decoding gives the text back, byte for byte.

    Whole texts are encoded, a chunk between two cuts at a time. NULL texts have NULL ids, 0 tokens
    and a true round trip; empty texts have no ids. Rows are independent, so repeats and NULL ids
    need no rule. Of the other columns only ``carry`` is read; it may not name ids, n_tokens, round_trip.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in texts:
            for begin in range(0, max(1, len(batch)), _ROWS):  # short batches out, so that few ids are held at a time
                ids, same = [], []
                for data in as_bytes(batch.slice(begin, _ROWS)):
                    found = None if data is None else encoder.encode(data.decode())
                    ids.append(found)
                    same.append(data is None or encoder.decode(found) == data)
                yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["ids", "round_trip"])

    coded = docs.select(*carry, run(F.col(text_col)).alias("coded"))
    return coded.select(*carry, F.col("coded.ids").alias("ids"), F.coalesce(F.size("coded.ids"), F.lit(0)).alias("n_tokens"),
                        F.col("coded.round_trip").alias("round_trip"))


def decode(coded: DataFrame, model_path: str = MODEL, ids_col: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carry columns, text) from arrays of ids; NULL stays NULL, ids that are no UTF-8 together give U+FFFD."""
    shared = coded.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    @F.arrow_udf("string")
    def run(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in ids:
            yield pa.array([None if v is None else encoder.decode(np.array(v, np.int64)).decode(errors="replace")
                            for v in batch.to_pylist()], pa.string())

    return coded.select(*carry, run(F.col(ids_col)).alias("text"))


def op6_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
