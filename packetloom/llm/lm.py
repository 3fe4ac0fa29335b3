"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word-count base."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import as_bytes, fold, stored, table
from packetloom.llm.wordbytes import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same words without looking ahead, which takes an automaton in place of backtracking, where the last white space of every run of
# several before a word begins a text of its own.
_PATTERN = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # \s of the vocabulary
_IS_WHITE = np.isin(np.arange(0x3002), _WHITE)
DIM, CONTEXT, STRIDE = 16, 32, 16  # model width; a window has CONTEXT inputs, of which the last STRIDE are scored
GROUPS, MEMBERS = 16, 16  # the softmax picks one of GROUPS, then one of its MEMBERS classes
BINS = 64  # classes of several ids, by equal mass; the most frequent ids have a class each
ONE_OF = 32  # of so many windows of every training text one is an example, of fewer where that gave less than a shard
SHARD = 1 << 16  # examples that one task descends over
STEPS = 1024  # of the first descent, by one task
HEAD = 1 << 17  # words whose counts every task gets; those of all other words are joined
SMOOTH = 0.1  # fixed value of the base: added to each count
_PAD = 65535
_BLOCK = 256
_ROWS = 512
_BYTES = 1 << 23
_KINDS = 200_000


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte strings and their ids; read once, by the driver."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(k) for piece, k in (line.split() for line in lines)}
    if len(ranks) >= _PAD - 1:
        raise ValueError(f"{path} has more ids than 16 bits hold beside end and padding")
    return ranks


_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(shared) -> tiktoken.Encoding:
    if id(shared.value) not in _encodings:
        _encodings.clear()
        unused = {"\0end": max(shared.value.values(), default=-1) + 1}  # never allowed, so it codes nothing; without any the coder into arrays would scan for an empty pattern
        _encodings[id(shared.value)] = tiktoken.Encoding("ids", pat_str=_PATTERN, mergeable_ranks=shared.value, special_tokens=unused)
    return _encodings[id(shared.value)]


def _ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text under PATTERN, from a coder under _PATTERN."""
    white = _IS_WHITE[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(_IS_WHITE) - 1)]
    cuts = (np.flatnonzero(white[:-2] & white[1:-1] & ~white[2:]) + 1).tolist()
    parts = [text[i:j] for i, j in pairwise([0, *cuts, len(text)])] if cuts else [text]
    ids = [encoding.encode_to_numpy(part, disallowed_special=()) for part in parts]
    return (np.concatenate(ids) if cuts else ids[0]).astype("<u2")


def subword_ids(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text") -> Column:
    """Column of 16-bit little-endian ids of whole texts; NULL counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(shared)
        for batch in texts:
            for begin in range(0, max(1, len(batch)), _ROWS):
                yield pa.array([_ids(encoding, (data or b"").decode()).tobytes() for data in as_bytes(batch.slice(begin, _ROWS))], pa.binary())

    return run(F.col(text_col))


def windows(ids: np.ndarray, end: int, context: int = CONTEXT, stride: int = STRIDE) -> np.ndarray:
    """Rows of ``context`` + 1 ids; the last ``stride`` of each are targets, each token and the end once in all.

    A text runs from a start (the end's id) to its end. Rows overlap by context - stride inputs, which only
    serve as context; what lies outside the text is padding.
    """
    targets = len(ids) + 1
    count = -(-targets // stride)
    row = np.full(context - stride + count * stride + 1, _PAD, np.uint16)
    row[context - stride] = end
    row[context - stride + 1:context - stride + targets] = ids
    row[context - stride + targets] = end
    return np.lib.stride_tricks.sliding_window_view(row, context + 1)[::stride]


@dataclass
class Classes:
    """Classes of ids by frequency, and the share of each id in its class, from counts of the whole training corpus."""

    of: np.ndarray
    log_share: np.ndarray
    log_mass: np.ndarray


def classes(counts: np.ndarray, size: int = GROUPS * MEMBERS, bins: int = BINS) -> Classes:
    """The most frequent ids are classes of one; the rest, by falling count, are cut into ``bins`` of equal mass; ``size`` in all."""
    singles = size - bins
    mass = counts + SMOOTH
    order = np.lexsort((np.arange(len(mass)), -mass))
    of = np.empty(len(mass), np.int64)
    of[order[:singles]] = np.arange(min(singles, len(mass)))
    rest = order[singles:]
    if len(rest):
        before = np.cumsum(mass[rest]) - mass[rest]
        of[rest] = singles + np.minimum(bins - 1, (before / mass[rest].sum() * bins).astype(np.int64))
    total = np.bincount(of, weights=mass, minlength=singles + bins)
    with np.errstate(divide="ignore"):
        log_mass = np.log(np.maximum(total, 1e-30) / mass.sum())
    return Classes(of, np.log(mass / total[of]), log_mass.astype(np.float32))


_STRIP = 200_000


def _times(s: np.ndarray, t: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``s`` times ``t``, in strips so small that the linear algebra library starts no threads of its own."""
    strip = max(1, _STRIP // t.size)
    if len(s) <= strip:
        return np.matmul(s, t, out=out)
    whole = len(s) // strip * strip
    out = np.empty((len(s), t.shape[1]), np.result_type(s, t)) if out is None else out
    np.matmul(s[:whole].reshape(-1, strip, s.shape[1]), t, out=out[:whole].reshape(-1, strip, t.shape[1]))
    np.matmul(s[whole:], t, out=out[whole:])
    return out


def _across(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``s`` transposed times ``t``, in such strips."""
    strip = max(1, _STRIP // (s.shape[1] * t.shape[1]))
    whole = len(s) // strip * strip
    part = lambda x: x[:whole].reshape(-1, strip, x.shape[1])
    return np.matmul(part(s).transpose(0, 2, 1), part(t)).sum(axis=0) + s[whole:].T @ t[whole:]


class Attention:
    """One causal head over a window, added to a map of the last token, then a softmax in two steps.

    h_i = tanh(x_i U + sum_j a_ij x_j V), a_i the softmax over j <= i of x_i Q . x_j K + bias[i - j];
    P(token) = P(group | h) x P(class | group, h) x share of the token in its class.
    """

    DENSE = ("q", "k", "v", "u", "bias", "wg", "bg", "w", "b")

    def __init__(self, ids: int, known: Classes, seed: int = 12):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape).astype(np.float32)
        self.known, self.end = known, ids - 1
        self.x = rng.normal(0, 0.5, (ids + 1, DIM)).astype(np.float32)  # the last row is padding
        self.q, self.k, self.v, self.u = (draw(DIM, DIM) for _ in range(4))
        self.bias = np.zeros((1, CONTEXT), np.float32)
        self.w, self.wg = 0.1 * draw(DIM, GROUPS * MEMBERS), 0.1 * draw(DIM, GROUPS)
        self.b = known.log_mass[None, :].copy()
        self.bg = np.log(np.exp(self.b, dtype=np.float64).reshape(1, GROUPS, MEMBERS).sum(axis=2)).astype(np.float32)
        late = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
        self.future, self.lag = late < 0, np.maximum(late, 0)

    def forward(self, rows: np.ndarray):
        """log P(target) of each row's targets (0 where padded), with what the gradient needs."""
        at = np.where(rows == _PAD, self.end + 1, rows).astype(np.int64)
        inputs, targets = at[:, :-1], at[:, CONTEXT - STRIDE + 1:]
        x = self.x[inputs]
        own = x[:, CONTEXT - STRIDE:]
        flat = lambda s, t: _times(s.reshape(-1, DIM), t).reshape(s.shape)
        q, k, v = flat(own, self.q), flat(x, self.k), flat(x, self.v)
        scores = q @ k.transpose(0, 2, 1)
        scores += self.bias[0][self.lag]
        scores += np.where(self.future, np.float32(-1e9), np.float32(0))
        scores += np.where(inputs > self.end, np.float32(-1e9), np.float32(0))[:, None, :]
        scores -= scores.max(axis=2, keepdims=True)
        a = np.exp(scores, out=scores)
        a /= a.sum(axis=2, keepdims=True)
        h = np.tanh(flat(own, self.u) + a @ v)
        last = h.reshape(-1, DIM)
        real = targets.ravel() <= self.end
        group, member = np.divmod(self.known.of[np.minimum(targets.ravel(), self.end)], MEMBERS)
        place = np.arange(len(group))
        inner = _times(last, self.w).reshape(-1, GROUPS, MEMBERS)[place, group] + self.b.reshape(GROUPS, MEMBERS)[group]
        logp = self.known.log_share[np.minimum(targets.ravel(), self.end)]
        chances = []
        for logits, goal in ((_times(last, self.wg) + self.bg, group), (inner, member)):
            logits -= logits.max(axis=1, keepdims=True)
            hit = logits[place, goal]
            chance = np.exp(logits, out=logits)
            total = chance.sum(axis=1, keepdims=True)
            logp = logp + hit - np.log(total[:, 0])
            chances.append((chance, total, goal))
        return np.where(real, logp, 0.0).reshape(targets.shape), (inputs, x, own, q, k, v, a, h, chances, group, real)

    def gradient(self, rows: np.ndarray) -> tuple[float, int, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Mean loss, number of targets, slopes of the dense parts, and (ids, slopes) of the embeddings met."""
        logp, (inputs, x, own, q, k, v, a, h, chances, group, real) = self.forward(rows)
        n = max(1, int(real.sum()))
        slopes = []
        for chance, total, goal in chances:
            slope = chance / total
            slope[np.arange(len(goal)), goal] -= 1
            slopes.append(slope * (real / np.float32(n))[:, None].astype(np.float32))
        outer = slopes[0]
        inner = np.zeros((len(group), GROUPS, MEMBERS), np.float32)
        inner[np.arange(len(group)), group] = slopes[1]
        inner = inner.reshape(len(group), -1)
        last = h.reshape(-1, DIM)
        dense = {"w": _across(last, inner), "b": inner.sum(axis=0, keepdims=True), "wg": _across(last, outer), "bg": outer.sum(axis=0, keepdims=True)}
        dz = ((_times(inner, self.w.T) + _times(outer, self.wg.T)) * (1 - last * last)).reshape(h.shape)
        both = lambda s, t: _across(s.reshape(-1, DIM), t.reshape(-1, DIM))
        dense["u"] = both(own, dz)
        dv = a.transpose(0, 2, 1) @ dz
        da = dz @ v.transpose(0, 2, 1)
        ds = a * (da - (a * da).sum(axis=2, keepdims=True))
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        dense["q"], dense["k"], dense["v"] = both(own, dq), both(x, dk), both(x, dv)
        dense["bias"] = np.bincount(self.lag.ravel(), weights=np.where(self.future, 0, ds.sum(axis=0)).ravel(), minlength=CONTEXT)[None, :]
        flat = lambda s, t: _times(s.reshape(-1, DIM), t).reshape(s.shape)
        dx = flat(dk, self.k.T) + flat(dv, self.v.T)
        dx[:, CONTEXT - STRIDE:] += flat(dq, self.q.T) + flat(dz, self.u.T)
        order = np.argsort(inputs, axis=None, kind="stable")
        ids = inputs.ravel()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return -float(logp.sum()) / n, n, dense, ids[first], np.add.reduceat(dx.reshape(-1, DIM)[order], first, axis=0)

    def descend(self, rows: np.ndarray, rate: float, batch: int = 64, steps: int = 0) -> np.ndarray:
        """Adaptive stochastic gradient descent, one pass or as many as make ``steps``; returns how often each embedding was met."""
        seen = {name: np.full_like(getattr(self, name), 1e-6) for name in self.DENSE}
        seen_x, met = np.full_like(self.x, 1e-6), np.zeros(len(self.x), np.int64)
        per_pass = -(-len(rows) // batch)
        rng = np.random.default_rng(len(rows))
        for k in range(max(per_pass, steps)):
            if k % per_pass == 0:
                order = rng.permutation(len(rows))
            at = k % per_pass * batch
            _, _, dense, ids, slope = self.gradient(rows[order[at:at + batch]])
            for name, g in dense.items():
                seen[name] += g * g
                getattr(self, name)[...] -= rate * g / np.sqrt(seen[name])
            seen_x[ids] += slope * slope
            self.x[ids] -= rate * slope / np.sqrt(seen_x[ids])
            met[ids] += 1
        return met

    def projected(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Key, value, 1 and query of each id, its part as last token, and the greatest key times the greatest query; made once for many texts.

        Padding has value 0 and 0 in place of 1, so that a window's sums leave it out. The last token's part has
        a further column whose tanh is 1: it takes the shifts of the logits.
        """
        real = (np.arange(len(self.x)) <= self.end).astype(np.float32)[:, None]
        key, query = self.x @ self.k, self.x @ self.q
        longest = lambda part: float(np.sqrt(np.square(part).sum(axis=1).max()))
        return (np.concatenate([key, self.x @ self.v * real, real, query], axis=1),
                np.concatenate([self.x @ self.u, np.full((len(self.x), 1), 20, np.float32)], axis=1), longest(key) * longest(query))

    def score(self, texts: list[np.ndarray], projected: tuple[np.ndarray, np.ndarray, float] | None = None) -> np.ndarray:
        """log10 P of each text and its end, every token scored once.

        The texts lie one after another, each after a lead of padding and padded to whole strides, so that
        window k begins at stride k and keys and values of overlapping windows are looked up once. A softmax
        is only shifted by its greatest exponent where the weights let exponents grow beyond 40. The targets of
        a block are sorted by group, so that a group's classes take one product.
        """
        per_id, as_last, most = projected or self.projected()
        key, value, query = slice(0, DIM), slice(DIM, 2 * DIM + 1), slice(2 * DIM + 1, None)
        sizes = np.array([len(t) for t in texts], np.int64)
        count = -(-(sizes + 1) // STRIDE)
        lead = -(-(CONTEXT - STRIDE) // STRIDE)
        strides = lead + -(-(sizes + 2) // STRIDE)
        begin = np.concatenate([[0], np.cumsum(strides)])
        line = np.full((begin[-1] + lead + 1) * STRIDE, self.end + 1, np.int64)
        owner = np.full(begin[-1], len(texts))
        for k, text in enumerate(texts):
            at = (begin[k] + lead) * STRIDE
            line[at] = line[at + len(text) + 1] = self.end
            line[at + 1:at + len(text) + 1] = text
            first = begin[k] + lead - (CONTEXT - STRIDE) // STRIDE
            owner[first:first + count[k]] = k
        steep = most + np.abs(self.bias).max() > 40
        wide = max(np.abs(m).sum(axis=0).max() + np.abs(c).max() for m, c in ((self.w, self.b), (self.wg, self.bg))) > 40
        allowed = np.where(self.future, np.float32(-np.inf), self.bias[0][self.lag])
        open_ = np.exp(allowed)
        group_of, member_of = (part.astype(np.uint8) for part in np.divmod(self.known.of, MEMBERS))
        outer = np.broadcast_to(self.wg, (GROUPS, DIM, GROUPS))
        maps = np.concatenate([self.w.reshape(DIM, GROUPS, MEMBERS).transpose(1, 0, 2), outer], axis=2)
        shifts = np.concatenate([self.b.reshape(GROUPS, 1, MEMBERS), np.broadcast_to(self.bg, (GROUPS, 1, GROUPS))], axis=2)
        maps = np.concatenate([maps, shifts], axis=1)
        ones = np.ones(max(GROUPS, MEMBERS), np.float32)
        total = np.zeros(len(texts) + 1)
        for w in range(0, begin[-1], _BLOCK):
            rows = min(_BLOCK, begin[-1] - w)
            at = line[w * STRIDE:(w + rows - 1) * STRIDE + CONTEXT + 1]
            z = per_id.take(at[:-1], axis=0)
            step = z.strides
            seen = np.lib.stride_tricks.as_strided(z, (rows, CONTEXT, z.shape[1]), (STRIDE * step[0], *step), writeable=False)
            a = z[CONTEXT - STRIDE:, query].reshape(rows, STRIDE, DIM) @ seen[:, :, key].transpose(0, 2, 1)
            if steep:
                a += allowed
                pad = np.where(at[:-1] > self.end, np.float32(-1e9), np.float32(0))
                a += np.lib.stride_tricks.as_strided(pad, (rows, 1, CONTEXT), (STRIDE * pad.strides[0], 0, pad.strides[0]))
                a -= a.max(axis=2, keepdims=True)
                np.exp(a, out=a)
            else:
                np.exp(a, out=a)
                a *= open_
            h = (a @ seen[:, :, value]).reshape(-1, DIM + 1)
            h /= h[:, DIM:] + np.float32(1e-30)  # 0 where all is padding, which has no target
            h += as_last.take(at[CONTEXT - STRIDE:-1], axis=0)
            np.tanh(h, out=h)
            targets = at[CONTEXT - STRIDE + 1:]
            goal = np.minimum(targets, self.end)
            group = group_of.take(goal)
            order = np.argsort(group, kind="stable")
            h = h.take(order, axis=0)
            logits = np.empty((len(h), MEMBERS + GROUPS), np.float32)
            stop = np.cumsum(np.bincount(group, minlength=GROUPS))
            for g, (first, last) in enumerate(zip([0, *stop[:-1]], stop, strict=True)):
                _times(h[first:last], maps[g], logits[first:last])
            if wide:
                logits[:, :MEMBERS] -= logits[:, :MEMBERS].max(axis=1, keepdims=True)
                logits[:, MEMBERS:] -= logits[:, MEMBERS:].max(axis=1, keepdims=True)
            goal, group, place = goal[order], group[order], np.arange(len(h))
            hit = logits[place, member_of.take(goal)] + logits[place, MEMBERS + group]
            chance = np.exp(logits, out=logits)
            logp = hit - np.log(chance[:, :MEMBERS] @ ones[:MEMBERS]) - np.log(chance[:, MEMBERS:] @ ones[:GROUPS]) + self.known.log_share[goal]
            logp[targets[order] > self.end] = 0
            total += np.bincount(owner[w:w + rows].repeat(STRIDE)[order], weights=logp, minlength=len(texts) + 1)
        return total[:-1] / math.log(10)


def _id_counts(coded: DataFrame, ids: int) -> np.ndarray:
    """How often each id occurs in all the texts; the last entry is the number of texts, their ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ids, np.int64)
        for batch in batches:
            part, size = [], 0
            for data in batch.column(0):
                part.append(np.frombuffer(data.as_buffer(), "<u2"))
                size += len(part[-1])
                if size >= _KINDS:
                    total += np.bincount(np.concatenate(part), minlength=ids)
                    part, size = [], 0
            total += np.bincount(np.concatenate([np.zeros(0, "<u2"), *part]), minlength=ids)
            total[ids - 1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ids, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


def _examples(coded: DataFrame, end: int, one_of: int, shards: int) -> DataFrame:
    """(shard, place, window): of every ``one_of`` windows one, drawn by a hash of the text's checksum and the window's number."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, place, found = [], [], []
            for key, data in zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1), strict=True):
                rows = windows(np.frombuffer(data.as_buffer(), "<u2"), end)
                h = mix(np.arange(len(rows), dtype=np.uint64) ^ key)
                at = np.flatnonzero(h % np.uint64(one_of) == 0)
                h = h[at] // np.uint64(one_of)
                shard.append(h % np.uint64(shards))
                place.append(h // np.uint64(shards))
                found += [row.astype("<u2").tobytes() for row in rows[at]]
            join = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *[p.astype(np.int64) for p in parts]]))
            yield pa.record_batch([join(shard), join(place), pa.array(found, pa.binary())], ["shard", "place", "window"])

    return coded.select(F.xxhash64("ids").alias("key"), "ids").mapInArrow(draw, "shard long, place long, window binary")


def _averaged(model: Attention, examples: DataFrame, rate: float, steps: int = 0) -> None:
    """Every shard descends from the same model in a task of its own; the model becomes the weighted mean of theirs."""
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("place", "ascending"), ("window", "ascending")])
        rows = np.stack([np.frombuffer(w.as_buffer(), "<u2") for w in part["window"]])
        own = Attention(shared.value.end + 1, shared.value.known)
        for name in ("x", *Attention.DENSE):
            setattr(own, name, getattr(shared.value, name).copy())
        met = own.descend(rows, rate, steps=steps)
        at = np.flatnonzero(met)
        names, places, weights, values = ["x"] * len(at), at.tolist(), met[at].astype(float).tolist(), own.x[at].astype(float).tolist()
        for name in Attention.DENSE:
            for k, row in enumerate(getattr(own, name)):
                names.append(name)
                places.append(k)
                weights.append(float(len(rows)))
                values.append(row.astype(float).tolist())
        return pa.table({"name": pa.array(names), "row": pa.array(places, pa.int64()), "weight": pa.array(weights),
                         "value": pa.array(values, pa.list_(pa.float64()))})

    parts = examples.groupBy("shard").applyInArrow(run, "name string, row long, weight double, value array<double>")
    mean = parts.select("name", "row", "weight", F.posexplode("value").alias("at", "v")).groupBy("name", "row", "at").agg(
        (F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v")).toArrow()
    shared.unpersist()
    names = mean["name"].to_numpy(zero_copy_only=False)
    row, at, v = (mean[c].to_numpy() for c in ("row", "at", "v"))
    for name in ("x", *Attention.DENSE):
        here = names == name
        getattr(model, name)[row[here], at[here]] = v[here]


def train(coded: DataFrame, ids: int, one_of: int = ONE_OF, shard: int = SHARD, passes: int = 1, rate: float = 0.2) -> Attention:
    """Fit on the coded training texts.

    Counts of ids, and with them classes and shares, come from every token. One window of ``one_of``
    of every text, drawn by hash, is an example, so their number grows with the corpus; a corpus too
    small for a shard of them gives more, up to all its windows. They are dealt over shards of about
    ``shard``: first one shard descends alone for STEPS steps, then in each of ``passes`` all do side by
    side and are averaged. The driver gets one model, its size set by the vocabulary.
    """
    counts = _id_counts(coded, ids)
    model = Attention(ids, classes(counts))
    expected = int(counts.sum() / STRIDE + counts[-1])
    one_of = max(1, min(one_of, expected // shard))
    shards = max(1, math.ceil(expected / one_of / shard))
    examples = stored(_examples(coded, ids - 1, one_of, shards))
    if examples.isEmpty():
        return model
    _averaged(model, examples.filter("shard = 0"), rate, STEPS)
    for k in range(passes):
        _averaged(model, examples, rate / (k + 2))
    return model


def scores(coded: DataFrame, model: Attention, ids_col: str = "ids") -> Column:
    """Column of log10 probabilities of coded texts."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        projected = shared.value.projected()
        for batch in ids:
            for begin in range(0, max(1, len(batch)), _ROWS):
                texts = [np.frombuffer(v.as_buffer(), "<u2") for v in batch.slice(begin, _ROWS)]
                yield pa.array(shared.value.score(texts, projected), pa.float64())

    return score(F.col(ids_col))


def _words(texts: pa.Array, size: int = _BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words, A-Z lower-cased, and where those of each text begin and the last one's end; a few rows and about ``size`` bytes at once."""
    texts = texts.cast(pa.string())
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy()) // size
    cuts = np.flatnonzero(np.diff(sizes, prepend=0) | (np.arange(len(texts)) % _ROWS == 0)).tolist()
    for i, j in pairwise([*cuts, len(texts)] if cuts else [0, 0]):
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, j - i).fill_null("")))  # the blanks of the contract
        words, begin = found.flatten(), found.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        real = pc.binary_length(words).to_numpy() > 0  # a blank at either end of a text gives an empty word
        if not real.all():
            words, begin = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[begin]
        yield words, begin
    pa.default_memory_pool().release_unused()  # workers outlive a batch and a task


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over one text column, A-Z lower-cased; NULL stands for the ends of texts. Each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[pa.Array, np.ndarray]] = []
        ends = kinds = 0

        def merged() -> tuple[pa.Array, np.ndarray]:
            words = pa.concat_arrays([words for words, _ in found]).dictionary_encode()
            n = np.zeros(len(words.dictionary), np.int64)
            np.add.at(n, words.indices.to_numpy(), np.concatenate([n for _, n in found]))
            return words.dictionary, n

        def out() -> pa.RecordBatch:
            words, n = merged()
            return pa.record_batch([words.cast(pa.binary()), pa.array(n)], ["word", "n"])

        for batch in batches:
            ends += batch.num_rows
            for words, _ in _words(batch.column(0), _BYTES // 16):
                met = words.value_counts()
                found.append((met.field("values"), met.field("counts").to_numpy()))
                kinds += len(met)
                if kinds > _KINDS:
                    found = [merged()]
                    kinds = len(found[0][0])
                if kinds > _KINDS // 2 and len(found) == 1:
                    yield out()
                    found, kinds = [], 0
        if found:
            yield out()
        yield pa.record_batch([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def _head(counts: DataFrame, most: int = HEAD) -> dict[bytes | None, int]:
    """Counts of the most frequent words, ``most`` at most and of 64 bytes at most each, and of the end.

    The least count follows from a histogram of counts on a log scale.
    """
    step = F.floor(8 * F.log2("n"))
    kept = counts.filter(F.col("word").isNull() | (F.octet_length("word") <= 64))
    least, total = 1 << 62, 0
    for row in sorted(kept.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    found = kept.filter(F.col("word").isNull() | (step >= least)).toArrow()
    return dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))


def looked_up(head: dict[bytes | None, int], rows: DataFrame, text_col: str = "text") -> Column:
    """Column struct(n_tokens, n_known, logs, rare): the base's sum over words of ``head``, and the other words with their numbers."""
    names = pa.array([word for word in head if word is not None], pa.binary())
    logs_of = np.array([*(math.log10(n + SMOOTH) for word, n in head.items() if word is not None), math.nan])  # the last one: of no word of the head
    end = math.log10(head[None] + SMOOTH) if None in head else math.nan
    shared = rows.sparkSession.sparkContext.broadcast((names, logs_of, end))

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,logs:double,rare:array<struct<word:binary,n:bigint>>>")
    def look(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, logs_of, end = shared.value
        names = names.cast(pa.string())
        for batch in texts:
            for words, begin in _words(batch):
                at = pc.index_in(words, value_set=names).fill_null(-1).to_numpy()
                n = len(begin) - 1
                value = np.insert(logs_of[at], begin[1:], end)
                known = ~np.isnan(value)
                ranges = list(pairwise((begin + np.arange(n + 1)).tolist()))
                tokens = np.diff(begin) + 1
                place = np.flatnonzero(at < 0)
                others = words.take(pa.array(place)).dictionary_encode()
                kinds = len(others.dictionary)
                key = (np.searchsorted(begin, place, side="right") - 1) * (kinds + 1) + others.indices.to_numpy()
                if math.isnan(end):
                    key = np.concatenate([key, np.arange(n) * (kinds + 1) + kinds])
                key, times = np.unique(key, return_counts=True)
                text, kind = np.divmod(key, kinds + 1)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [others.dictionary.cast(pa.binary()).take(pa.array(kind, mask=kind == kinds)), pa.array(times, pa.int64())], ["word", "n"]))
                yield pa.StructArray.from_arrays(
                    [pa.array(tokens, pa.int64()), pa.array([int(known[i:j].sum()) for i, j in ranges], pa.int64()),
                     pa.array([float(value[i:j][known[i:j]].sum()) for i, j in ranges], pa.float64()), rare], ["n_tokens", "n_known", "logs", "rare"])

    return look(F.col(text_col))


def lm_scores(docs: DataFrame, parts: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text",
              path: str = VOCABULARY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Ids with crc32 modulo ``parts`` equal to ``held`` teach nothing; a NULL id teaches and is not held out.
    NULL counts as an empty text, which has its end as only token. Scores are log10 probabilities:
    ``base_score`` of lower-cased words under smoothed counts, ``score`` of the subword ids of the text as
    it stands, ended. Without training rows counts are 0 and every id is about as likely. Repeated rows get
    equal scores and count as often as they occur. Further columns are not read.

    Words of the head are looked up where the text is read, all others are joined with their counts; none of
    these is frequent, so no task of that join gets a hot word.
    """
    out = F.coalesce(fold(id_col, parts) == held, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    counts = stored(word_counts(rows.filter("not held_out").select("text")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocabulary = read_vocabulary(path)
    coded = stored(rows.select("id", "held_out", F.monotonically_increasing_id().alias("row"), subword_ids(rows, vocabulary).alias("ids"),
                               looked_up(_head(counts), rows).alias("t")).select("id", "held_out", "row", "ids", "t.*"))
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(
        counts.select("word", F.col("n").alias("c")), "word", "left")
    rest = stored(rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("tail")))
    model = train(coded.filter("not held_out"), max(vocabulary.values(), default=0) + 2)
    scored = coded.select("row", "id", "held_out", "n_tokens", "n_known", "logs", scores(coded, model).alias("score"))
    below = math.log10(total + SMOOTH * (kinds + 1))
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")


def op12_lm_scores(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
