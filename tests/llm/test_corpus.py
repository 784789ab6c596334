"""Importance resampling, fingerprints and the source audit against plain loops."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import divergence, fingerprints, importance
from touchline.llm.common import matches, ranked

from .conftest import DOCS, ODD

WORD11 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD13 = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def found(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def plain_resample(docs, target, longest=1, buckets=10_000, fewest=20, percent=10):
    def hashed(text):
        ws = found(WORD11, text)
        return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(hashed(x))
    for x in target:
        t.update(hashed(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    out, able = {}, []
    for i, x in docs:
        hs = hashed(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in hs)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(hs), weight, score, None]
        if len(found(WORD11, x)) >= fewest:
            able.append((-score, i))
    for place, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][3] = place
    return out


def drawn(frame):
    return {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in frame.collect()}


def test_resampling_against_a_loop(spark, real, docs_of):
    docs, texts = real
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    wanted = [r.text for r in target.collect()]
    assert drawn(importance.resample(docs, target)) == plain_resample(list(texts.items()), wanted)
    got = importance.resample(docs, target, longest=3, buckets=97, fewest=5, percent=37)
    assert drawn(got) == plain_resample(list(texts.items()), wanted, 3, 97, 5, 37)


def test_runs_across_pieces_of_a_long_text(monkeypatch):
    raw = b"ab cd9 \xc3\xa9x " * 50 + b"z" * 300
    assert list(itertools.chain(*matches(importance._WORD, raw, 16))) == importance._WORD.findall(raw)
    whole = Counter(itertools.chain(*(x.tolist() for x, _ in importance.hashed(raw, 3, importance._Buckets(997)))))
    monkeypatch.setattr(importance, "matches", lambda pattern, r: matches(pattern, r, 8))
    cut = Counter(itertools.chain(*(x.tolist() for x, _ in importance.hashed(raw, 3, importance._Buckets(997)))))
    assert cut == whole


@pytest.mark.parametrize("draw", [1, 2, 50, 299, 300])
def test_cutoff_by_brackets(spark, draw):
    rng = random.Random(draw)
    rows = [(rng.choice([7, 7, 7, rng.randrange(100)]), i, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long").repartition(7)
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))[draw - 1]
    # A first bracket that is far too narrow must be widened.
    assert importance.cutoff(df, draw, error=0.0005) == expected
    assert importance.cutoff(df, draw, error=0.3) == expected


def test_resampling_of_odd_rows(spark, docs_of, odd_docs, no_docs):
    target = docs_of(["one two three", None, ""])
    got = importance.resample(odd_docs, target, fewest=2, percent=50).collect()
    able = [r for r in got if r.n_features >= 2]
    assert len(got) == 2 * len(ODD) + 1 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(able) // 2 + 1))
    for r in got:
        if not r.n_features:
            assert r.weight == 0 and r["rank"] is None
    # Twelve equal rows of which six are due.
    same = docs_of(["one two three"]).crossJoin(spark.range(12).select(F.col("id").alias("n_features")))
    got = importance.resample(same, target, fewest=2, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6] and len(got) == 12
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(docs_of(["a b"]), no_docs, fewest=1, percent=100).first()["rank"] == 1


def test_ranked_counts_on_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("kept").alias("_at")).repartition(13)
    out = ranked(df, [F.desc("x")], "place")
    assert out.columns == ["x", "_at", "place"] and all(r.x + r.place == 1000 for r in out.collect())


def plain_entropies(raw):
    width, most = fingerprints.WIDTH, fingerprints._MOST
    held = [sum(int(fingerprints._LOG[c]) for c in Counter(raw[i : i + width]).values()) for i in range(len(raw) - width + 1)]
    return [(most - x) * fingerprints.BINS // most for x in held]


def plain_features(raw, ranks):
    """Windows as bytes, in order, by one look at every run of windows."""
    width = fingerprints.WIDTH
    if not raw:
        return []
    if len(raw) < width:
        return [raw + bytes(width - len(raw))]
    r = [ranks[b] for b in plain_entropies(raw)]
    points = Counter()
    for end in range(1, len(r) + width):
        run = range(max(0, end - width), min(len(r), end))
        points[min(run, key=lambda i: (r[i], i))] += 1
    chosen = [raw[i : i + width] for i in range(len(r)) if points[i] >= fingerprints.POINTS]
    return list(dict.fromkeys(chosen))


@pytest.fixture(scope="module")
def some_texts(real):
    rng = random.Random(5)
    texts = [t for t in real[1].values()][:25]
    texts += ["", "a", "x" * 31, "x" * 32, "y" * 400, "é" * 100, "".join(rng.choice("abé你 \n") for _ in range(900)), "word " * 300]
    return [t.encode() for t in texts]


def test_features_against_a_loop(some_texts, monkeypatch):
    counts = np.zeros(fingerprints.BINS + 1, np.int64)
    for t in some_texts:
        bins = plain_entropies(t if len(t) >= fingerprints.WIDTH else t + bytes(fingerprints.WIDTH - len(t))) if t else []
        counts += np.bincount(np.array(bins, np.int64), minlength=fingerprints.BINS + 1)
    assert (fingerprints.bin_counts(some_texts) == counts).all()
    ranks = fingerprints.ranks_of(counts)
    expected = []
    for t in some_texts:
        windows = plain_features(t, ranks)
        raw = np.frombuffer(b"".join(windows), np.uint8)
        expected.append(fingerprints._hashes(raw, np.arange(len(windows)) * fingerprints.WIDTH).tolist() if windows else [])
    assert [x.tolist() for x in fingerprints.features(some_texts, ranks)] == expected
    # The same when every text is long and goes piece by piece.
    monkeypatch.setattr(fingerprints, "PIECE", 97)
    assert (fingerprints.bin_counts(some_texts) == counts).all()
    assert [x.tolist() for x in fingerprints.features(some_texts, ranks)] == expected


def plain_likeness(a, b):
    """Filters as sets of bits."""

    def parse(written):
        chain = fingerprints.Chain.parse(written)
        bits = [{i for i in range(2048) if int(row[i // 64]) >> (i % 64) & 1} for row in chain.bits]
        return [(s, min(160, chain.held.sum() - 160 * i)) for i, s in enumerate(bits)]

    def score(x, y):
        (s, n), (t, m) = x, y
        most, q = min(len(s), len(t)), 1 - 1 / 2048
        chance = 2048 * (1 - q ** (5 * n) - q ** (5 * m) + q ** (5 * n + 5 * m))
        least = chance + 0.3 * (most - chance)
        return max(0.0, (len(s & t) - least) / (most - least))

    x, y = parse(a), parse(b)
    if not x or not y:
        return float(len(x) == len(y))
    one_way = lambda p, q: sum(max(score(f, g) for g in q) for f in p) / len(p)
    return (one_way(x, y) + one_way(y, x)) / 2 if len(x) == len(y) else one_way(*sorted((x, y), key=len))


def test_fingerprint_query_against_a_loop(spark, real):
    docs, texts = real
    ranks = fingerprints.rarity(docs)
    order = sorted(texts, reverse=True)
    chains = {i: str(fingerprints.Chain.of(h)) for i, h in zip(order, fingerprints.features([(texts[i] or "").encode() for i in order], ranks))}
    got = {r.doc_id: r for r in fingerprints.compared(docs.repartition(5), ranks).collect()}
    assert len(got) == len(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        t, u = texts[i] or "", texts[j] or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + u[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), chains[i])
        written = str(fingerprints.Chain.of(fingerprints.features([changed.encode()], ranks)[0]))
        assert r.edited_fingerprint == written
        assert r.near_edited == pytest.approx(plain_likeness(chains[i], written)) and r.near_next == pytest.approx(plain_likeness(chains[i], chains[j]))
    longer = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited > 0.3 and r.near_next < 0.2 for r in longer) > 0.95 * len(longer)
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs.withColumn("fingerprint", F.lit(1)), ranks).collect()} == chains


def test_fingerprints_of_odd_rows(spark, docs_of, odd_docs, no_docs):
    ranks = fingerprints.rarity(odd_docs)
    rows = fingerprints.compared(odd_docs, ranks).collect()
    assert len(rows) == 2 * len(ODD) + 1
    by_text = defaultdict(set)
    written = fingerprints.fingerprint(odd_docs, ranks).collect()
    for r in written:
        by_text[r.text or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {"0:"}
    # Equal neighbours are fully alike; the null id comes last, and its next is the first.
    pairs = [r for r in rows if r.doc_id == 6]
    assert {r.near_next for r in pairs} >= {1.0} and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    last = next(r for r in rows if r.doc_id is None)
    t, u = "one two three", ODD[-1]
    assert last.edited_sha256 == hashlib.sha256((t[: len(t) - 4] + u[:4]).encode()).hexdigest()
    assert fingerprints.compared(no_docs, ranks).count() == 0 and fingerprints.rarity(no_docs).shape == (1001,)
    alone = fingerprints.compared(docs_of(["abc def " * 30]), ranks).first()
    assert alone.near_next == 1.0 and alone.near_edited > 0.9


def plain_audit(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, ws = lang or "", source or "", found(WORD13, text)
        groups.add((lang, source))
        counts[lang, source].update(ws)
        docs[lang].update(set(ws))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def p(some):
            c = Counter()
            for s in some:
                c.update({t: n for t, n in counts[lang, s].items() if docs[lang][t] >= least})
            total = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own, every = p([source]), p(sources)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(s, sum(f(own[t], q) for t, q in p([s]).items())) for s in sources if s != source]
        terms = [(t, f(own[t], every[t])) for t in kept if counts[lang, source][t] and own[t] > every[t]]
        for part, listed, upto in (("pair", pairs, None), ("term", terms, top)):
            listed.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, *x, i) for i, x in enumerate(listed[:upto], 1)}
    return out


def test_audit_against_a_loop(spark, real, monkeypatch):
    docs, _ = real
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert {tuple(r) for r in divergence.audit(docs).collect()} == plain_audit(rows)
    # Blocks of four terms, counts handed on early, groups met in a shuffled join.
    for name, value in (("BLOCK_BITS", 2), ("HELD", 50), ("BROADCAST_GROUPS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert {tuple(r) for r in divergence.audit(docs, least_docs=3, top=4).collect()} == plain_audit(rows, 3, 4)


def test_audit_of_odd_rows(spark, docs_of, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in divergence.audit(odd_docs, least_docs=2).collect()} == plain_audit(rows, 2)
    # No term is kept: distances of 0, names in order.
    got = divergence.audit(odd_docs.withColumn("term", F.lit(1)), least_docs=1000).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, 1000) and got and all(r.value == 0 for r in got)
    assert divergence.audit(no_docs).count() == 0


def test_shares_beyond_64_bits():
    big = np.array([0, 9_000_000_000, 10**12], np.int64)
    assert divergence._shares(big, 10**13, 7).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 14) for c in big.tolist()]
    assert divergence.meet((np.array([0]), np.array([5])), (np.array([0, 3]), np.array([5, 8])), 10) == 7 * (9 // 13)
