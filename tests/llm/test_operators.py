"""Every operator against a brute-force version, with NULLs, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import exact, jaccard, langid, mixing, pieces, pii, quality, secret_scan, urls, vectors, wordbytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, row int, size int, digest int, score int"
SMALL = "/root/testdata/sf0.001"


def _row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 6))) for _ in range(500)]
    out = []
    for k in range(60):
        base = rng.choices(words, k=rng.randint(30, 90))
        out.append(_row(3 * k, " ".join(base), source=rng.choice(["a", "b", "c", None])))
        for j in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(_row(3 * k + 1000 + 300 * j, (" " if j % 2 else "\n").join(copy), source=rng.choice(["a", "b", None])))
    out += [_row(9000, None), _row(9001, ""), _row(9002, " \t\n"), _row(None, "one two three four five six"), _row(9003, "two"), _row(9004, "two "),
            out[0], out[0], _row(9005, " ".join(words * 40)), _row(9006, "▁ mark ▁▁ and\u0000 ✓ 漢字 \n\n end ", None),
            _row(None, None), _row(9007, "x" * 200_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digest", ["sha256", "weak"])
def test_exact_dedup(docs, rows, digest):
    weak = lambda content: F.unhex(F.substring(F.sha2(content, 256), 1, 2))  # noqa: E731  contents share digests
    got = exact.exact_dedup(docs, digest=exact.sha256 if digest == "sha256" else weak).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_bare(r[1])].append(r)
    keep = {c: max(g, key=lambda r: (len(r[1] or ""), -(r[0] if r[0] is not None else 10 ** 18)))[0] for c, g in groups.items()}
    want = sorted((str(r[0]), str(keep[c]), len(groups[c]), r[0] == keep[c], hashlib.sha256(c.encode()).hexdigest())
                  for r in rows for c in [_bare(r[1])])
    assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in got) == want


def test_exact_survivors(docs, rows, none):
    left = exact.survivors(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert Counter(_bare(r["text"]) for r in got) == dict.fromkeys({_bare(r[1]) for r in rows}, 1)
    assert exact.survivors(none).count() == 0 and exact.exact_dedup(none).count() == 0


def _jaccard_truth(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n, links = len(rows), Counter()
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[root[k]].append(r[0])
    return [(r[0], min(ids[root[k]], default=None), links[k]) for k, r in enumerate(rows)], root


def test_jaccard_join(docs, rows, none):
    got = jaccard.jaccard_join(docs, block=2)  # tiny blocks: groups span several tasks
    want, _ = _jaccard_truth(rows)
    assert sum(w[2] for w in want) > 40
    assert sorted(map(str, got.select("doc_id", "class_id", "n_links").rdd.map(tuple).collect())) == sorted(map(str, want))
    assert jaccard.jaccard_join(none).count() == 0


def test_jaccard_survivors(docs, rows):
    left = jaccard.survivors(docs)
    assert left.columns == docs.columns
    want, root = _jaccard_truth(rows)
    stay = {(r[0], r[1]) for r, w, k in zip(rows, want, root, strict=True) if not (r[1] or "").split() or r[0] == w[1]}
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, stay))


def test_prefixes_shorten_until_the_target_recall():
    assert jaccard.matched_depth(0.8, 32, 8, 0.999) == 7
    assert jaccard.matched_depth(0.8, 32, 8, 0.9999) == 6
    assert jaccard.matched_depth(0.8, 200, 8, 0.999) == 8
    with pytest.raises(ValueError):
        jaccard.matched_depth(0.1, 1, 8, 0.999)


def test_word_hashes_do_not_depend_on_place():
    text = ("alpha beta alpha\tgamma " * 90_000 + "y" * (3 << 20) + " alpha").encode()
    got = wordbytes.word_hashes(text)
    assert len(got) == 4 * 90_000 + 2 and got[0] == got[2] == got[-1] != got[1]
    assert len(wordbytes.word_hashes(b"")) == 0 and len(wordbytes.word_hashes(b"  \n")) == 0


def _targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > ceiling * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in above:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mix(docs, rows, none):
    got = mixing.mix(docs, shard_rows=8, block=4, carry=["source"]).collect()
    again = mixing.mix(docs.repartition(7), shard_rows=8, block=4, carry=["source"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    target = _targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 8 + 0.02 * target[s]
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def _whole_copies(rows, bucket=512):
    """Plain version of mixing.whole_copies over (n, source, size, taken, place, draw)."""
    copies = {}
    for source in {r["source"] for r in rows}:
        mine = sorted((r for r in rows if r["source"] == source and r["size"]), key=lambda r: (r["place"], r["draw"], r["n"]))
        if not mine:
            continue
        base, extra = divmod(sum(r["taken"] for r in mine), sum(r["size"] for r in mine))
        at, chosen = 0, []
        for r in mine:
            chosen.append(at + r["size"] / 2 <= extra)
            at += r["size"]
        while True:
            left = extra - sum(r["size"] for r, c in zip(mine, chosen, strict=True) if c)
            line = [k for k in range(len(mine)) if chosen[k] == (left < 0) and mine[k]["size"] < 2 * abs(left)]
            ahead, moved = 0, []
            for k in line if left > 0 else line[::-1]:
                if ahead + mine[k]["size"] / 2 <= abs(left):
                    moved.append(k)
                ahead += mine[k]["size"]
            if not moved:
                break
            for k in moved:
                chosen[k] = not chosen[k]
        copies |= {r["n"]: base + c for r, c in zip(mine, chosen, strict=True)}
    return copies


def test_mixed_documents_keep_the_words_of_a_hot_source_with_very_long_documents(spark):
    rng = random.Random(11)
    hot = [rng.randint(5, 60) for _ in range(1200)] + [rng.randint(4000, 9000) for _ in range(24)]
    sources = [("hot", hot), ("few", [3000, 4000, 5000]), *((f"s{k}", [rng.randint(5, 40) for _ in range(30)]) for k in range(12))]
    texts = [(source, " ".join(["w"] * n)) for source, sizes in sources for n in sizes]
    docs = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    size = {k: len(t.split()) for k, (_, t) in enumerate(texts)}
    target = _targets({s: sum(sizes) for s, sizes in sources}, share=0.3)
    made = Counter(r["doc_id"] for r in mixing.mixed_documents(docs, share=0.3, shard_rows=64).select("doc_id").collect())
    assert max(made.values()) <= 2 and 0.1 < target["hot"] / sum(hot) < 0.5
    words = Counter()
    for k, n in made.items():
        words[texts[k][0]] += n * size[k]
    for s, sizes in sources:
        assert abs(words[s] - target[s]) <= 40 + (max(sizes) / 2 if s == "few" else 0), s
    longs = sum(n for k, n in made.items() if size[k] >= 4000 and texts[k][0] == "hot")
    assert 2 <= longs <= 18  # of 24, at a share of about a third
    sized = docs.select(*mixing._sized("doc_id", "text", "source", 17), F.col("doc_id").alias("n"))
    streams = mixing.stored(mixing._streams(sized, (3, 1, 2), 0.3, 2.0, 16, 64, 17).select("n", "source", "size", "taken", "place", "draw"))
    got = {r["n"]: r["copies"] for r in mixing.whole_copies(streams, bucket_rows=16).collect()}
    assert got == _whole_copies(streams.collect())


def test_apportion_gives_the_highest_quotients(spark):
    rng = random.Random(2)
    for blocks, votes in ((37, [rng.random() * 9 for _ in range(12)]), (7, [1.0] * 5), (100, [1e-3, 5.0, 5.0, 1e6]), (3, [2.0, 0.0])):
        cells = spark.createDataFrame([(k, v) for k, v in enumerate(votes)], "cell long, votes double")
        got = {r["cell"]: r["quota"] for r in mixing.apportion(cells, blocks, order=["cell"]).collect()}
        best = sorted((-v / (2 * j + 1), k) for k, v in enumerate(votes) if v for j in range(blocks))[:blocks]
        assert got == {k: sum(b[1] == k for b in best) for k in range(len(votes))}


def _viterbi(vocabulary, text):
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 40), end):  # longer pieces first
            piece = text[begin:end]
            if piece in vocabulary.pieces:
                k, score = vocabulary.pieces[piece]
            elif len(piece) == 1:
                k, score = None, vocabulary.unknown_score
            else:
                continue
            if best[end] is None or best[begin][0] + score > best[end][0]:
                best[end] = (best[begin][0] + score, best[begin][1] + ([k] if k is not None else [vocabulary.byte_ids[b] for b in piece.encode()]))
    return best[-1][1]


def test_pieces(docs, rows, none, spark):
    vocabulary = pieces.read_vocabulary()
    encoder = pieces.Encoder(vocabulary)
    sample = [r["text"][:3000] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect()] + ["  a   b\n\n c ", "漢字✓\u0000", " "]
    for text in sample:
        assert encoder.encode(text).tolist() == _viterbi(vocabulary, "▁" + text.replace(" ", "▁"))
    coded = pieces.encode(docs, carry=("doc_id", "id"))
    assert coded.filter("not round_trip").count() == 0 and coded.count() == len(rows)
    back = pieces.decode(coded).withColumnRenamed("text", "back").collect()
    assert Counter(r["back"] for r in back) == Counter(r[1] for r in rows)
    assert pieces.encode(none).count() == 0


def test_language_id(spark, docs, rows, none):
    real = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").withColumn("score", F.lit("clash"))
    got = langid.language_id(real).join(real.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == r["truth"] for r in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    assert {odd[k]["lang_pred"] for k in (9000, 9001, 9002)} == {"und"} and odd[9003]["lang_pred"] == "en"
    assert langid.language_id(none).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_subwords_of_long_texts_are_all_counted(monkeypatch):
    text = "some words, élan 12 and more ".encode() * 40
    whole = langid.subword_counts(text)
    monkeypatch.setattr(langid, "_STRIP", 17)
    assert np.array_equal(whole, langid.subword_counts(text)) and langid.subword_counts(b"").sum() == 0


def test_quality(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("label", F.lit(0))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality(real, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in got)
    lone = quality.quality(docs, spark.createDataFrame([(9003, 1), (None, 0), (9004, None)], "doc_id long, quality int"))
    assert lone.count() == docs.count() and lone.filter("score is null").count() == 0
    assert quality.quality(none, labels).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    at, x = np.array([3, 70, 4100]), np.array([0.5, 1.0, 2.0])
    pairs = sum(fm.factors[at[i]] @ fm.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert math.isclose(fm.margin(at, x), 0.3 + fm.weights[at] @ x + pairs)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    made = [b + 0.12 * rng.normal(size=16) for b in base for _ in range(rng.integers(1, 9))] + list(rng.normal(size=(60, 16)))
    data = [(k, [float(x) for x in v], 7) for k, v in enumerate(made)]
    data += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [None] + [1.0] * 15, 1), (5003, [float("nan")] * 16, 1), (None, data[0][1], 1),
             (5004, data[0][1], 1), (5005, [1e200] * 16, 1), (5006, [1e-200] * 16, 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1), (5009, [], 1), data[3]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, links int")
    got = vectors.near_vectors(df, n_pivots=5, block=7).collect()
    usable = {k: np.array(v) / max(map(abs, v)) for k, v, _ in data if k is not None and v and None not in v
              and np.isfinite(v).all() and any(v)}
    link = {a: {b for b in usable if a != b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b]
                >= 0.9 * np.linalg.norm(usable[a]) * np.linalg.norm(usable[b])} for a in usable}
    least = {k: k for k in {r[0] for r in data}}
    for _ in data:
        for a in link:
            least[a] = min([least[a], *(least[b] for b in link[a])])
    want = sorted(str((k, len(link.get(k, ())), least[k], True if k is None else k == least[k])) for k in least)
    assert sorted(str(tuple(r)) for r in got) == want and sum(map(len, link.values())) > 50
    assert vectors.near_vectors(df.limit(0)).count() == 0


def _url_scores(rows, order):
    """Plain Witten-Bell scores of all urls from (url, verdict or None)."""
    grams = lambda u: ["\x01" * order + u + "\x02"][0]
    held = lambda u: zlib.crc32(u.encode()) % 5 == 0
    tables = {}
    for side in ("allow", "block"):
        follow = defaultdict(Counter)
        for u, v in rows:
            if v == side and not held(u):
                p = grams(u)
                for k in range(len(u) + 1):
                    for o in range(order + 1):
                        follow[p[k + order - o:k + order]][p[k + order]] += 1
        tables[side] = follow

    def chance(follow, context, c):
        below = chance(follow, context[1:], c) if context else 1 / 256
        seen = follow.get(context)
        return (seen[c] + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen else below

    out = {}
    for u, _ in rows:
        p = grams(u)
        out[u] = np.mean([math.log(chance(tables["allow"], p[k:k + order], p[k + order]))
                          - math.log(chance(tables["block"], p[k:k + order], p[k + order])) for k in range(len(u) + 1)])
    return out


def _rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in urls.RULES for h, _, p in [r.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_filter(spark):
    pages = [(r["page_id"], r["url"], 1) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages += [(7010, None, 1), (None, "", 1), (7001, "no scheme/x", 1), (7002, "HTTP://WWW.Example.NET/en/?q=http://a.b/", 1), (7003, "x://net", 1),
              (7004, "x://é.ORG/fr/#a?b", 1), (7005, "x://example.org?/fr/", 1), pages[0], (7006, "x://notnet/" + "q" * 5000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, score int")
    got = urls.url_filter(df, order=2).collect()
    assert len(got) == len(pages)
    want = _url_scores([(u or "", _rule(u)[3]) for _, u, _ in pages], 2)
    scores = defaultdict(list)
    for (_, u, _) in pages:
        scores[str((*_rule(u)[:3],))].append(want[u or ""])
    for r in got:
        assert any(math.isclose(r["score"], s, abs_tol=1e-9) for s in scores[str((r["host"], r["path"], r["rule"]))])
    by_id = {r["page_id"]: r for r in got}
    for k, u, _ in pages:
        host, path, rule, verdict = _rule(u)
        if rule:
            assert (by_id[k]["host"], by_id[k]["path"], by_id[k]["rule"], by_id[k]["verdict"]) == (host, path, rule, verdict)
    free = [r for r in got if r["rule"] is None]
    assert max(r["score"] for r in free if r["verdict"] == "block") < min(r["score"] for r in free if r["verdict"] == "allow")
    assert urls.url_filter(df.limit(0)).count() == 0


TEXTS = ["write to ann.lee7@mail.example.org or ANN.LEE7@MAIL.EXAMPLE.ORG!!", "call +1 (017) 555-7713 or +1 017 555 7713", "from 10.2.3.44### and 10.2.3.45.",
         "card 4929348385146306, again 4929 3483 8514 6306", "Mrs. Anna Petrova met Mr Ivan Petrova and Mrs Petrova", "Frau Ида Иванова kam", "nothing here 12.5 999.1.1.1 1234", "", None]


def test_pii(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS * 2)] + [(None, TEXTS[0], "y")], "doc_id long, text string, kind string")
    rows = pii.surrogates(df).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(TEXTS) * 2 + 1 and all(got[k] == got[k + len(TEXTS)] for k in range(len(TEXTS)))
    mail, loud = re.findall(r"\S+@[\w.]+", got[0])
    assert loud == mail.upper() and mail.endswith(".org") and "ann" not in mail and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.org", mail)
    phones = re.findall(r"\+1 [\d ()-]+\d", got[1])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "10175557713" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", got[2]))) == 2 and "10.2.3" not in got[2]
    cards = re.findall(r"\d[\d ]{15,}", got[3])
    assert cards[0] == cards[1].replace(" ", "") != "4929348385146306"
    she, he, again = re.findall(r"(?:Mrs\.?|Mr) (?:[A-Z][a-z]+ )?([A-Z][a-z]+)", got[4])
    assert she == again != he and she[-1] == "a" and he[-1] not in "aeiou" and "Petrova" not in got[4]
    assert re.search(r"Frau [А-Я][а-я]+ [А-Я][а-я]+а kam", got[5])
    assert (got[6], got[7], got[8]) == tuple(TEXTS[6:])
    assert pii.surrogates(df.limit(0)).count() == 0


def test_pii_collisions_are_drawn_again(spark):
    short = [(k, f"{a}@{b}.io and 1.1.1.{k % 9}") for k, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")]
    df = spark.createDataFrame(short, "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split()[0] for r in pii.surrogates(df).collect()}
    assert len(set(got.values())) == len(short)  # 100 of 676 possible ones: the first draws collide
    assert not set(got.values()) & {t.split()[0] for _, t in short}


def test_given_names_never_share_a_surrogate(spark):
    given = [f"{a}{b}" for a in "ABCDEFGHIJKLMNOPQRST" for b in "eiouy"]  # of 234 that end in a consonant
    df = spark.createDataFrame([(k, f"Mr {g} Smith") for k, g in enumerate([*given, "Ab", "Cd", "Ek"])], "doc_id long, text string")
    got = [r["text"].split()[1:] for r in pii.surrogates(df).collect()]
    assert len({g for g, _ in got}) == len(given) + 3 and len({s for _, s in got}) == 1
    assert not {g for g, _ in got} & {*given, "Ab", "Cd", "Ek", "Smith"}


def test_surrogates_grow_when_their_space_is_used_up(spark):
    names = [f"{a}{b}" for a in "ABCDEFGHIJKLMNO" for b in "ou"]  # 30, where 26 end in a
    texts = [f"Ms {n} wrote" for n in names] + [f"Ms {a}a wrote" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    got = pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    made = {r["text"].split()[1] for r in got}
    assert len(made) == 56 and not made & {t.split()[1] for t in texts}
    assert all(re.fullmatch(r"[A-Z][a-z]+a", m) for m in made)
    grown = spark.range(1).select(*[pii.rendered(F.lit(raw), F.lit(kind), pii.surrogate(F.lit(kind), F.lit(entity), F.lit(70)), F.lit("")).alias(kind)
                                    for raw, kind, entity in (("+1 (017) 555-7713", "phone", "10175557713"), ("a@b.io", "email", "a@b.io"),
                                                              ("10.2.3.4", "address", "10.2.3.4"))]).first()
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{6}", grown["phone"]) and re.fullmatch(r"[a-z]{9}@[a-z]\.io", grown["email"])
    assert grown["address"].count(".") == 5


def test_pii_of_other_shapes(spark):
    found = {"(555) 123-4567": "phone", "020 7946 0958": "phone", "+49 30 1234567": "phone", "555-123-4567": "phone", "378282246310005": "card",
             "3782 822463 10005": "card", "6304 0000 0000 0000 000": "card", "2001:db8::8a2e:370:7334": "address6", "078-05-1120": "social",
             "DE89 3704 0044 0532 0130 00": "account", "GB82WEST12345698765432": "account"}
    kept = ["378282246310006", "1700000000000", "2024-01-15 12:30:45", "std::vector", "v1.2.3", "DE88 3704 0044 0532 0130 00", "0.1234567890123"]
    df = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate([*found, *kept])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(df).collect()}
    shape = lambda t: re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", t))
    for k, (t, kind) in enumerate(found.items()):
        assert got[k]["kinds"] == [kind] and t not in got[k]["text"] and shape(got[k]["text"]) == shape(f"see {t} here"), t
    for k, t in enumerate(kept):
        assert (got[len(found) + k]["text"], got[len(found) + k]["n_entities"]) == (f"see {t} here", 0), t


def test_secret_scan(spark):
    rng = random.Random(8)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    secrets = [token() for _ in range(40)]
    texts = [f'see the token = "{s}" in here' for s in secrets] + [f"the internationalisation{k % 9} of communications/and/directories{k}" for k in range(40)]
    texts += [f"wonderfully{'y' * 8} 1234567890123456789 token = example_placeholder_value"] * 20 + [None, "", "short"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, label int")
    got = secret_scan.secret_scan(df).collect()
    told = Counter((r["value_sha256"], r["secret"]) for r in got)
    assert all((hashlib.sha256(s.encode()).hexdigest(), True) in told for s in secrets)
    assert sum(r["secret"] for r in got) == len(secrets) + 1
    one = secret_scan.secret_scan(df.filter("doc_id < 5")).collect()
    assert len(one) == 5 and not any(r["secret"] for r in one)
    assert secret_scan.secret_scan(df.limit(0)).count() == 0


def test_secret_scan_reads_assignments_within_a_word_and_short_values(spark):
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choices("0123456789abcdefXYZ", k=n - 1)) + "7"
    short, cut, glued, json = ([draw(n) for _ in range(20)] for n in (10, 9, 32, 24))
    cut = [f"{c}!{c[::-1]}@1" for c in cut]
    texts = [f'the password = "{s}" here' for s in short] + [f"passwd: {c} here" for c in cut] + [f"export API_KEY={g} now" for g in glued]
    texts += [f'{{"id":"{"z" * 20}","password":"{j}"}}' for j in json] + [f"the internationalisation{k} of communications/and/directories{k}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {(r["doc_id"], r["value_sha256"]): r["secret"] for r in secret_scan.secret_scan(df).collect()}
    for k, value in enumerate(short + cut + glued + json):
        assert told[k, hashlib.sha256(value.encode()).hexdigest()], texts[k]
    assert not told[60, hashlib.sha256(b"z" * 20).hexdigest()] and sum(told.values()) == 80
    plain = spark.createDataFrame([(1, 'password = "Tr0ub4dor&3" x token="abcd1234" q?auth=k1k2k3k4&b=1 aaaa=bbbbbbbbbbbb=c1c1c1 cGFkZGVkIHZhbHVlIQ== (secret: p4ssw0rd)')], "doc_id long, text string")
    assert {r["value"] for r in secret_scan.candidates(plain).collect()} == {
        "Tr0ub4dor&3", "abcd1234", "k1k2k3k4", "aaaa=bbbbbbbbbbbb=c1c1c1", "cGFkZGVkIHZhbHVlIQ==", "p4ssw0rd"}


def test_near_vectors_are_not_copied_for_each_pair_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    made = np.concatenate([base, base[:100] + 0.01 * rng.normal(size=(100, 16)), np.repeat(base[7:8], 60, axis=0)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], "vec_id long, embedding array<double>")
    written = []
    kept = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda rows: written.append(kept(rows)) or written[-1])
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, n_pivots=4, block=9).collect()}
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    assert [got[k]["n_links"] for k in range(len(made))] == (linked.sum(axis=1) - 1).tolist() and got[400]["component_id"] == 7
    blocks = next(t for t in written if "vectors" in t.columns)
    assert blocks.select(F.sum(F.octet_length("ids"))).first()[0] == 8 * len(made) and blocks.count() > 20
    plan = vectors._links_of_length(spark, vectors._packed(df, "vec_id", "embedding"), 128, 0.9, 0.5, 4, 9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_near_vectors_of_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=2).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == [("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("None", 0, "None")]


def test_near_vectors_of_floats(spark):
    rng = np.random.default_rng(5)
    made = np.concatenate([base := rng.normal(size=(60, 8)), 3 * base[:20] + 0.02, [[0.0] * 8]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(made)] + [(100, None), (101, [None] * 8), (102, [float("inf")] * 8), (103, [1e-30] * 8), (104, [2e-30] * 8)]
    got, want = (sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), block=7).collect()))
                 for kind in ("float", "double"))
    assert got == want and sum(r[1] for r in got) > 40
