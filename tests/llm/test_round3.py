"""Fill-in-middle, language-model scores and the manifest against brute-force versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard

from packetloom.llm import fim, lm, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, pos int, total int, digest int, frames int, output int"


def _row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    letters = "abc DEF\n\t<>éß漢😀"
    out = [_row(k, "".join(rng.choices(letters, k=rng.randint(0, 90))), rng.choice(["a", "b", "é", "", None])) for k in range(150)]
    out += [_row(200 + k, text, source) for k, (text, source) in enumerate([
        (None, None), ("", "a"), ("with <P> mark", "b"), ("<S>", "b"), ("<M", "b"), ("<<S", "solo"), ("😀" * 40_000 + "é<" * 30_000, "a"),
        ("x" * 200_000, None), ("a\u0000b", "a"), ("é" * 3, "b")])]
    return out + [out[0], out[0], _row(None, "no id"), _row(None, None, None), (5, None, None, None, None, "x", 1, 2, 3, 4, 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _cut(doc_id, text):
    text = text or ""
    h = _sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:low], text[low:high], text[high:]
    if h4 % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", low, high - low, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("frame_bytes", [1, 7, fim.FRAME_BYTES])
def test_fill_in_middle(docs, rows, none, frame_bytes):
    rows = [r for r in rows if frame_bytes > 100 or len(r[1] or "") < 1000]
    small = docs if frame_bytes > 100 else docs.filter("text is null or char_length(text) < 1000")
    cut = fim.fill_in_middle(fim.framed(small, frame_bytes=frame_bytes))
    got = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", fim.output_text(cut["output"]).alias("text"),
                     fim.output_digests(cut["output"], cut["form"]).alias("d")).collect()
    want = Counter((r[0], *_cut(r[0], r[1])) for r in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    whole = Counter((r[0], _sha(_cut(r[0], r[1])[4]), _sha(r[1] or "")) for r in rows)
    assert Counter((r["doc_id"], r["d"]["output_sha256"], r["d"]["restored_sha256"]) for r in got) == whole
    assert fim.fill_in_middle(fim.framed(none)).collect() == []


def test_only_cut_frames_are_opened(monkeypatch):
    text = "".join(random.Random(1).choices("aé漢😀", k=5000))
    store = fim.frame_text(text.encode(), 512)
    press, calls = zstandard.ZstdCompressor(), []
    real = fim.opened
    monkeypatch.setattr(fim, "opened", lambda frames: (calls.extend(frames), real(frames))[1])
    found = fim.select(store, 700, 4100, press)
    assert b"".join(real(found)).decode() == text[700:4100]
    assert len(calls) == 2 and len(store.frames) > 20
    assert fim.select(store, 9, 9, press) == []


def test_restoring_reads_nothing_but_output_and_form():
    press = zstandard.ZstdCompressor()
    for text in ("<<S", "P><S", "a<", "<M<P", "ends <P"):
        for form, order in (("psm", "PSM"), ("spm", "SPM")):
            for a in range(len(text) + 1):
                for b in range(a, len(text) + 1):
                    part = {"P": text[:a], "M": text[a:b], "S": text[b:]}
                    whole = "".join(f"<{k}>{part[k]}" for k in order).encode()
                    for size in (1, 2, 3, 99):
                        frames = [press.compress(whole[k:k + size]) for k in range(0, len(whole), size)]
                        assert b"".join(fim.restored(frames, form)).decode() == text


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes, k):
    """Root of a list of digests, and the siblings of node ``k`` with their places, level by level."""
    steps = []
    while len(nodes) > 1:
        run = nodes[k // 16 * 16:k // 16 * 16 + 16]
        steps.append((run, k % 16))
        nodes = [_hash(nodes[j:j + 16]) for j in range(0, len(nodes), 16)]
        k //= 16
    return nodes[0], steps


def _manifest(rows):
    leaf = lambda r, text: _hash([_field(r[0]), _field(r[3]), _field(r[2]), _field(r[4]), _field(text)])
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    nodes = {s: [x[2] for x in sorted(by_source[s], key=lambda x: x[:3])] for s in names}
    tops = [_climb(nodes[s], 0)[0] for s in names]
    out = []
    for at, s in enumerate(names):
        root, above = _climb(tops, at)
        for k, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            subroot, steps = _climb(nodes[s], k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded, proof = leaf(r, low(r[1])) if changed else own, []
            for run, slot in steps + above:
                proof += run[:slot] + run[slot + 1:]
                folded = _hash([*run[:slot], folded, *run[slot + 1:]])
            out.append((r[0], own, subroot, root, _hash(proof), folded, folded == root))
    return out


def _op13(df):
    from pyspark.sql import functions as F
    return merkle.manifest(df, tampered=merkle.fold("doc_id", 5) == 0, tampered_text=F.translate("text", merkle.UPPER, merkle.LOWER))


def test_manifest(docs, rows, none):
    got = _op13(docs).collect()
    assert Counter(map(tuple, got)) == Counter(_manifest(rows))
    assert {r["verified"] for r in got} == {True, False}
    assert _op13(none).collect() == []
    assert all(r["verified"] for r in merkle.manifest(docs).collect())


@pytest.mark.parametrize("sources", [1, 4200])
def test_manifest_of_more_rows_than_one_task_holds(spark, sources):
    rows = [_row(k, f"Text {k}", f"s{k % sources}") for k in range(4200)]
    got = _op13(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(_manifest(rows))


def test_round_three_sql_runs_on_odd_rows(spark, docs, rows):
    con = duckdb.connect()
    documents = docs.filter("text is null or not contains(text, char(0))").toPandas()  # noqa: F841
    con.register("documents", documents.astype({"doc_id": "Int64", "n_chars": "Int64"}))
    got = Counter(map(tuple, con.execute(merkle.OP13_SQL).fetchall()))
    kept = [r for r in rows if r[1] is None or "\u0000" not in r[1]]
    assert got == Counter(_manifest(kept))


def _base(rows):
    """(n_tokens, n_known, train_tokens, base) by row, counted plainly."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", lower(r[1])) if w] + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total, kinds = sum(count.values()), len(count)
    return [(r[0], h, len(t), sum(count[w] > 0 for w in t), total,
             sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)) for r, t, h in zip(rows, tokens, held, strict=True)]


def _slow_score(model, ids):
    """log10 P of a text, one token at a time, in plain Python over the model's numbers."""
    sequence = [model.end, *ids.tolist(), model.end]
    known, total = model.known, 0.0
    for k in range(len(sequence) - 1):
        first = max(0, k // lm.STRIDE * lm.STRIDE - (lm.CONTEXT - lm.STRIDE))
        x = [model.x[t].astype(float) for t in sequence[first:k + 1]]
        q = x[-1] @ model.q
        s = [q @ (y @ model.k) + model.bias[0][len(x) - 1 - j] for j, y in enumerate(x)]
        a = [math.exp(v - max(s)) for v in s]
        h = np.tanh(x[-1] @ model.u + sum(v / sum(a) * (y @ model.v) for v, y in zip(a, x, strict=True)))
        goal = known.of[sequence[k + 1]]
        group, member = divmod(int(goal), lm.MEMBERS)
        outer = h @ model.wg + model.bg[0]
        inner = (h @ model.w + model.b[0])[group * lm.MEMBERS:(group + 1) * lm.MEMBERS]
        total += outer[group] - np.log(np.exp(outer).sum()) + inner[member] - np.log(np.exp(inner).sum()) + known.log_share[sequence[k + 1]]
    return total / math.log(10)


@pytest.mark.parametrize("head", [0, 40, lm.HEAD])
def test_lm_scores(docs, rows, none, head, monkeypatch):
    kept = {}
    train, whole = lm.train, lm._head
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("model", train(*a, one_of=2, **k)))
    monkeypatch.setattr(lm, "_head", lambda counts: whole(counts, head))
    got = lm.lm_scores(docs).collect()
    near = lambda r: (*r[:5], round(r[5], 6))
    assert Counter(near(r) for r in got) == Counter(near(r) for r in _base(rows))
    model, texts = kept["model"], {r[0]: r[1] for r in rows if r[0] not in (None, 5) and len(r[1] or "") < 1000}
    coding = tiktoken.Encoding("t", pat_str=lm.PATTERN, mergeable_ranks=lm.read_vocabulary(), special_tokens={})
    for r in got:
        if r["doc_id"] in texts:
            want = _slow_score(model, np.array(coding.encode_ordinary(texts[r["doc_id"]] or ""), "<u2"))
            assert r["score"] == pytest.approx(want, rel=1e-4, abs=1e-3)
        assert r["score"] < 0
    assert lm.lm_scores(none).collect() == []


def test_lm_chances_of_all_next_tokens_add_up_to_one():
    counts = np.random.default_rng(2).integers(0, 50, 700)
    model = lm.Attention(700, lm.classes(counts))
    model.descend(np.stack([lm.windows(np.arange(k, k + 15, dtype=np.uint16), 699)[0] for k in range(64)]), 0.2)
    row = lm.windows(np.array([3, 5, 8], np.uint16), 699)[0].copy()
    total = 0.0
    for token in range(700):
        row[lm.CONTEXT - lm.STRIDE + 3] = token
        total += math.exp(model.forward(row[None, :])[0][0, 2])
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_windows_score_each_token_once():
    for n in (0, 1, lm.STRIDE - 1, lm.STRIDE, 5 * lm.STRIDE + 3):
        rows = lm.windows(np.arange(n, dtype=np.uint16), 1000)
        targets = rows[:, lm.CONTEXT - lm.STRIDE + 1:].ravel()
        assert targets[targets != 65535].tolist() == [*range(n), 1000]
        for row in rows[1:]:
            assert (row[:lm.CONTEXT - lm.STRIDE + 1] != 65535).all() or n < lm.CONTEXT


@pytest.mark.parametrize("q, w", [(1, 1), (400, 1), (1, 400), (400, 400)])
def test_lm_scores_of_steep_weights_follow_the_forward_pass(q, w):
    rng = np.random.default_rng(3)
    model = lm.Attention(700, lm.classes(rng.integers(0, 90, 700)))
    model.q, model.w, model.wg = model.q * np.float32(q), model.w * np.float32(w), model.wg * np.float32(w)
    model.bias[0] = rng.normal(0, 1, lm.CONTEXT)
    texts = [rng.integers(0, 699, n).astype(np.uint16) for n in (0, 1, lm.STRIDE - 1, lm.STRIDE, 500, 9 * lm.CONTEXT + 5, 0)]
    want = [model.forward(lm.windows(t, 699))[0].sum(dtype=np.float64) / np.log(10) for t in texts]
    assert np.allclose(model.score(texts), want, rtol=2e-5)
    assert np.allclose(model.score(texts[::-1], model.projected()), want[::-1], rtol=2e-5)


def test_lm_learns(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [r for r in lm.lm_scores(sf).collect() if r["held_out"]]
    assert len(got) > 5 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 1.2


def test_short_batches_bound_what_python_gets_at_once(spark):
    from pyspark.sql import functions as F

    from packetloom.llm.common import short_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.num_rows]})

    longest = lambda: spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    with short_batches(spark, 256):
        assert longest() <= 256
    assert spark.conf.get(name) == before and longest() > 256


def test_ids_of_texts_that_hold_the_unused_mark(spark):
    texts = ["a\0end b", "\0end", "", "x  y\n\n 'll \0"]
    found = spark.createDataFrame([(t,) for t in texts], "text string")
    vocabulary = lm.read_vocabulary()
    coding = tiktoken.Encoding("t", pat_str=lm.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    got = found.select("text", lm.subword_ids(found, vocabulary).alias("ids")).collect()
    assert all(np.frombuffer(r["ids"], "<u2").tolist() == coding.encode_ordinary(r["text"]) for r in got) and len(got) == 4


def test_score_makes_no_pass_over_all_ids_where_these_are_projected(monkeypatch):
    model = lm.Attention(50, lm.classes(np.ones(50)))
    projected, texts = model.projected(), [np.array([1, 2, 3], np.uint16), np.zeros(0, np.uint16)]
    want = model.score(texts)
    monkeypatch.setattr(np, "square", None)
    assert np.array_equal(model.score(texts, projected), want)


def test_words_outside_the_head_are_counted_per_text(spark):
    docs = spark.createDataFrame([("a B a x x y",), (None,), ("",)], "text string")
    got = [r["t"] for r in docs.coalesce(1).select(lm.looked_up({b"a": 3, b"b": 1}, docs).alias("t")).collect()]
    assert [(r["n_tokens"], r["n_known"], [(bytes(w["word"]) if w["word"] is not None else None, w["n"]) for w in r["rare"]]) for r in got] == [
        (7, 3, [(b"x", 2), (b"y", 1), (None, 1)]), (1, 0, [(None, 1)]), (1, 0, [(None, 1)])]
    assert got[0]["logs"] == pytest.approx(2 * np.log10(3.1) + np.log10(1.1)) and got[1]["logs"] == 0


def test_coding_without_looking_ahead_gives_the_ids_of_the_whole_pattern():
    assert "(?!" not in lm._PATTERN and "(?=" not in lm._PATTERN
    vocabulary = lm.read_vocabulary()
    whole, ahead = (tiktoken.Encoding("t", pat_str=p, mergeable_ranks=vocabulary, special_tokens={}) for p in (lm.PATTERN, lm._PATTERN))
    parts = ["a", "B", "the", "'s", "'ll", "'", "1", "é", "!", " ", "  ", "\n", "\t", *map(chr, lm._WHITE), "\x1c", "\x1f", "\u180e", "\u200b", "\ufeff", "\U0001f600", "\0"]
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert lm._ids(ahead, text).tolist() == whole.encode_ordinary(text), repr(text)


def test_words_and_their_counts_are_made_in_arrays(spark):
    """As bytes split them: only the blanks of ASCII part words, only A-Z are lower-cased, blanks at the ends give no word."""
    texts = ["", " ", None, " a  B\x0b\x1cc ", "É\xa0e\n\nE\t", "\x85", "x" * 300, "b b\r\nb"]
    batch = pa.array(texts).slice(1)
    found = [(words.to_pylist(), begin.tolist()) for words, begin in lm._words(batch)]
    assert len(found) == 1 and [(len(w), b.tolist()) for w, b in lm._words(batch.slice(0, 0))] == [(0, [0])]
    words, begin = found[0]
    want = [(t or "").encode().lower().split() for t in texts[1:]]
    assert [[w.encode() for w in words[i:j]] for i, j in zip(begin, begin[1:], strict=False)] == want
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in lm.word_counts(rows).collect()}
    assert got == Counter(w for t in want for w in t) | {None: 8}


class _Caught:
    """Stands for a table; keeps the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        raise StopIteration


def _task(call, *args):
    caught = _Caught()
    with pytest.raises(StopIteration):
        call(caught, *args)
    return caught.run


def test_a_task_gives_out_words_before_they_are_too_many(monkeypatch):
    monkeypatch.setattr(lm, "_KINDS", 1000)
    monkeypatch.setattr(lm, "_ROWS", 7)
    texts = [" ".join(f"w{(k * j) % 997}x{j % 5}" for j in range(90)) for k in range(120)]
    given = list(_task(lm.word_counts)(iter([pa.record_batch([pa.array(texts[k:k + 50])], ["t"]) for k in (0, 50, 100)])))
    got = Counter()
    for batch in given:
        for row in batch.to_pylist():
            got[row["word"]] += row["n"]
    assert got == Counter(w.encode() for t in texts for w in t.split()) | {None: 120}
    assert len(given) > 3 and all(batch.num_rows <= 2000 + 7 * 90 for batch in given)


def test_ids_of_many_texts_are_counted_in_one_pass_over_all_ids(monkeypatch):
    rows = [np.arange(k % 9, dtype="<u2") for k in range(500)]
    passes, count = [], np.bincount
    run = _task(lm._id_counts, 12)
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or count(*a, **k))
    got, = run(iter([pa.record_batch([pa.array([r.tobytes() for r in rows[:400]]).slice(100)], ["ids"]), pa.record_batch([pa.array([r.tobytes() for r in rows[400:]])], ["ids"])]))
    want = count(np.concatenate(rows[100:]), minlength=12)
    want[11] += 400
    assert dict(zip(*got.to_pydict().values(), strict=True)) == {k: n for k, n in enumerate(want.tolist()) if n} and len(passes) == 2
