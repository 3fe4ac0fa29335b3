"""Fill-in-middle transformation over texts kept as seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import as_bytes, short_batches, stored, table

FRAME_BYTES = 1 << 16
LEVEL = 1
SEED = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"  # fixed values: the marks of the output
PLAIN_FROM, SPM_BELOW = 90, 20  # fixed values: h3 % 100 from here on is plain, h4 % 100 below here is spm
FRAMES = "struct<ends:array<bigint>,frames:array<binary>>"
_ROWS = 256


@dataclass
class Seekable:
    """A text as independent frames; ``ends[k]`` counts the code points up to the end of frame k."""

    ends: list[int]
    frames: list[bytes]

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0


def _units(data: bytes) -> int:
    """Code points: bytes that do not continue one."""
    if data.isascii():
        return len(data)
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def _offset(data: bytes, units: int) -> int:
    """Byte offset at which the first ``units`` code points end."""
    if units == 0 or data.isascii():
        return units
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(starts[units]) if units < len(starts) else len(data)


def frame_text(data: bytes, size: int = FRAME_BYTES, press: zstandard.ZstdCompressor | None = None) -> Seekable:
    """Frames of at most ``size`` bytes (a code point more at most), cut between code points; an empty text has none."""
    press = press or zstandard.ZstdCompressor(level=LEVEL)
    ends, frames, at, total = [], [], 0, 0
    while at < len(data):
        end = min(len(data), at + max(1, size))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        part = data[at:end]
        total += _units(part)
        ends.append(total)
        frames.append(press.compress(part))
        at = end
    return Seekable(ends, frames)


def opened(frames: Iterable[bytes]) -> Iterator[bytes]:
    """The frames' bytes in order, one frame at a time."""
    press = zstandard.ZstdDecompressor()
    return (press.decompress(f) for f in frames)


def select(text: Seekable, begin: int, end: int, press: zstandard.ZstdCompressor) -> list[bytes]:
    """Frames that hold the code points from ``begin`` up to ``end``.

    Only the frames that a border cuts are opened and pressed anew; those between are handed on.
    """
    found = []
    k = bisect_right(text.ends, begin)
    while begin < end:
        first = text.ends[k - 1] if k else 0
        last = min(end, text.ends[k])
        if begin == first and last == text.ends[k]:
            found.append(text.frames[k])
        else:
            data = next(opened(text.frames[k:k + 1]))
            found.append(press.compress(data[_offset(data, begin - first):_offset(data, last - first)]))
        begin, k = last, k + 1
    return found


def holds_mark(frames: Iterable[bytes], marks: tuple[bytes, ...] = (PREFIX, SUFFIX, MIDDLE)) -> bool:
    """Whether any mark occurs, also across a border of frames."""
    reach = max(map(len, marks)) - 1
    tail = b""
    for data in opened(frames):
        part = tail + data[:reach]
        if any(m in data or m in part for m in marks):
            return True
        tail = (tail + data)[-reach:]
    return False


def draws(doc_id: int | str | None, seed: int = SEED) -> list[int]:
    """h1 to h4: the first four groups of eight digits of the digest of seed and id; a NULL id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


@dataclass
class Cut:
    """A transformed text: its form, the sizes in code points, and the output as ordered frames."""

    form: str
    units: int
    prefix: int | None
    middle: int | None
    frames: list[bytes]


def transform(text: Seekable, doc_id: int | str | None, seed: int = SEED, press: zstandard.ZstdCompressor | None = None) -> Cut:
    n = text.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if n == 0 or h3 % 100 >= PLAIN_FROM or holds_mark(text.frames):
        return Cut("plain", n, None, None, text.frames)
    press = press or zstandard.ZstdCompressor(level=LEVEL)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = (select(text, *span, press) for span in ((0, low), (low, high), (high, n)))
    p, s, m = (press.compress(mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < SPM_BELOW:
        return Cut("spm", n, low, high - low, [s, *suffix, p, *prefix, m, *middle])
    return Cut("psm", n, low, high - low, [p, *prefix, s, *suffix, m, *middle])


def digest(frames: Iterable[bytes]) -> str:
    """Hex sha256 of the frames' bytes, streamed in order."""
    state = hashlib.sha256()
    for data in opened(frames):
        state.update(data)
    return state.hexdigest()


def _sections(frames: list[bytes], marks: tuple[bytes, ...]) -> list[tuple[int, int, int, int]]:
    """(frame, byte, frame, byte) from the end of each mark to the start of the next, the marks found in order by a scan."""
    found, tail, k, skip = [], b"", 0, 0
    borders: list[tuple[int, int]] = []  # start of the mark, then its end, as positions over all bytes
    sizes = [0]
    for data in opened(frames):
        sizes.append(sizes[-1] + len(data))
        window, base = tail + data, sizes[-2] - len(tail)
        at = max(0, skip - base)
        while k < len(marks) and (hit := window.find(marks[k], at)) >= 0:
            borders.append((base + hit, base + hit + len(marks[k])))
            at = hit + len(marks[k])
            skip = base + at
            k += 1
        tail = window[-(len(marks[0]) - 1):]
    if k < len(marks):
        raise ValueError("the output does not hold its marks")
    ends = [b for b, _ in borders[1:]] + [sizes[-1]]
    for (_, begin), end in zip(borders, ends, strict=True):
        first, last = bisect_right(sizes, begin) - 1, bisect_right(sizes, end) - 1
        found.append((first, begin - sizes[first], last, end - sizes[last]))
    return found


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text's bytes rebuilt from an output and its form alone, a frame at a time.

    A first pass finds the marks; the sections are then opened in the order of the text, each from
    the frame at which it starts.
    """
    if form == "plain":
        yield from opened(frames)
        return
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    by_mark = dict(zip(marks, _sections(frames, marks), strict=True))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        first, begin, last, end = by_mark[mark]
        for k, data in enumerate(opened(frames[first:last + 1]), first):
            yield data[begin if k == first else 0:end if k == last else len(data)]


def _each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    for batch in batches:
        for begin in range(0, max(1, len(batch[0])), _ROWS):  # short batches out, so that few texts are held at a time
            yield tuple(c.slice(begin, _ROWS) for c in batch)


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(id, text as struct(ends, frames)): a store of texts that can be cut without opening them whole."""

    @F.arrow_udf(FRAMES)
    def pressed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for (texts,) in _each((b,) for b in batches):
            kept = [frame_text(data or b"", frame_bytes, press) for data in as_bytes(texts)]
            yield pa.StructArray.from_arrays([pa.array([k.ends for k in kept], pa.list_(pa.int64())), pa.array(
                [k.frames for k in kept], pa.list_(pa.binary()))], ["ends", "frames"])

    return docs.select(id_col, pressed(F.col(text_col)).alias("text"))


def _stores(column: pa.Array) -> Iterator[Seekable]:
    return (Seekable(row["ends"], row["frames"]) for row in (value.as_py() for value in column))


def fill_in_middle(store: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of a store of ``framed`` texts.

    ``output`` is the ordered list of frames; together they are one zstandard stream of the text's
    output. NULL and empty texts are plain with n 0 and no frames. Lengths are code points. A NULL
    id draws as an empty one, so repeated ids are cut at the same places; further columns are not read.
    """

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:array<binary>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for ids, texts in _each(batches):
            cuts = [transform(text, k, seed, press) for k, text in zip(ids.to_pylist(), _stores(texts), strict=True)]
            yield pa.StructArray.from_arrays([
                pa.array([c.units for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()),
                pa.array([c.prefix for c in cuts], pa.int64()), pa.array([c.middle for c in cuts], pa.int64()),
                pa.array([c.frames for c in cuts], pa.list_(pa.binary()))],
                ["n", "form", "prefix_chars", "middle_chars", "output"])

    return store.select(id_col, run(F.col(id_col), F.col(text_col)).alias("cut")).select(id_col, "cut.*")


def output_digests(output: Column, form: Column) -> Column:
    """struct(output_sha256, restored_sha256) of an output's frames; the second is of the text rebuilt from them."""

    @F.arrow_udf("struct<output_sha256:string,restored_sha256:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in _each(batches):
            first, second = [], []
            for value, kind in zip(outputs, forms.to_pylist(), strict=True):
                frames = value.as_py()
                first.append(digest(frames))
                state = hashlib.sha256()
                for data in restored(frames, kind):
                    state.update(data)
                second.append(state.hexdigest())
            yield pa.StructArray.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string())],
                                             ["output_sha256", "restored_sha256"])

    return run(output, form)


def output_text(output: Column) -> Column:
    """The output as a string."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (outputs,) in _each((b,) for b in batches):
            yield pa.array([b"".join(opened(v.as_py())).decode() for v in outputs], pa.string())

    return run(output)


def op11_fill_in_middle(spark, sf_dir):
    with short_batches(spark, _ROWS):
        store = stored(framed(table(spark, sf_dir, "documents")))
    return fill_in_middle(store).withColumn("digests", output_digests(F.col("output"), F.col("form"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "digests.*")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3,
    ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
