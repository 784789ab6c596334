"""Near duplicates of texts and vectors, and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import minhash_forest, quality, vector_forest

from .conftest import ODD

WORD = re.compile(r"[^ \t-\r]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, percent):
    """Smallest id reachable, by comparing all pairs that share a shingle."""
    ids, holds, parent = sorted(sets), {}, {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for s in sets[i]:
            holds.setdefault(s, []).append(i)
    pairs = {(a, b) for members in holds.values() for n, b in enumerate(members) for a in members[:n]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def edited(rng, words, share):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_same_components_as_all_pairs(docs_of, real, k, percent):
    rng = random.Random(k)
    texts = list(real[1].values()) + ODD + ["One two THREE", "b", "B ", "x y", "x  y\n"]
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts += [edited(rng, base, rng.choice([0, 0.004, 0.01, 0.02, 0.03, 0.05])) for _ in range(150)]
    texts += [" ".join(base).upper()] * 5
    out = {r.doc_id: r for r in minhash_forest.near_duplicates(docs_of(texts), words=k, percent=percent).collect()}
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    expected = components(sets, percent)
    assert {i: out[i].n_shingles for i in out} == {i: len(s) for i, s in sets.items()}
    wrong = [i for i in out if out[i].component_id != expected[i]]
    assert not wrong
    assert all(out[i].kept == (expected[i] == i) for i in out)


def test_one_base_of_many_unlike_variants(docs_of):
    """Each variant is like the base only; all hang together by it."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(302)]
    texts = [" ".join(base)]
    for i in range(2_700):
        at = rng.randrange(280)
        texts.append(" ".join(base[:at] + [f"v{i}x{j}" for j in range(20)] + base[at + 20 :]))
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    like = [len(sets[0] & s) / len(sets[0] | s) for s in sets.values()]
    assert sum(100 * x >= 85 for x in like) == len(texts)
    apart = rng.sample(range(1, 2_701), 60)
    unlike = [100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a in apart for b in apart if a < b]
    assert sum(unlike) > 0.8 * len(unlike)
    out = minhash_forest.near_duplicates(docs_of(texts), words=3, percent=85).collect()
    assert {r.component_id for r in out} == {0}


def test_shingle_hashes_do_not_depend_on_neighbours():
    texts = [t or "" for t in ODD] + ["a b c d", "a b c d e"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    hashes, starts = minhash_forest.shingles(np.frombuffer(b"".join(raw), np.uint8), bounds, 3)
    for i, r in enumerate(raw):
        alone, _ = minhash_forest.shingles(np.frombuffer(r, np.uint8), np.array([0, len(r)]), 3)
        assert (hashes[starts[i] : starts[i + 1]] == alone).all()
        assert len(set(alone.tolist())) == len(shingles(texts[i], 3))


def test_odd_rows(spark, odd_docs, no_docs):
    out = minhash_forest.near_duplicates(odd_docs, words=3).collect()
    assert len(out) == 2 * len(ODD) + 1
    nobody = [r for r in out if r.doc_id is None]
    assert [(r.component_id, r.kept, r.n_shingles) for r in nobody] == [(None, True, 1)]
    assert all(r.component_id == r.doc_id for r in out if r.doc_id is not None)
    one = minhash_forest.keep_one(odd_docs)
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == list(range(len(ODD)))
    assert one.columns == odd_docs.columns and one.filter("doc_id is null").count() == 1
    # One id with two texts ties what either is linked with.
    same = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    tied = spark.createDataFrame(same, "doc_id long, text string")
    assert {r.component_id for r in minhash_forest.near_duplicates(tied).collect()} == {1}
    assert minhash_forest.near_duplicates(no_docs).count() == 0
    assert minhash_forest.keep_one(no_docs).count() == 0


def clusters(rng, n, dim, label):
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 2, 40])):
            rows.append((centre + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3])).tolist())
    return [(label, v) for v in rows[:n]]


@pytest.mark.parametrize("leaf_rows", [1024, 100])
def test_links_of_vectors(spark, leaf_rows):
    rng = np.random.default_rng(3)
    found = clusters(rng, 900, 16, 1) + clusters(rng, 300, 16, 2) + [(1, [1.0] * 16)] * 7 + [(None, [1.0] * 16), (3, [1.0] * 8)]
    rows = [(i, [float(x) for x in v], label) for i, (label, v) in enumerate(found)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in vector_forest.near_vectors(vectors, leaf_rows=leaf_rows).collect()}
    links, true = 0, 0
    for label in (1, 2):
        ids = [i for i, _, x in rows if x == label]
        x = vector_forest.unit(np.array([rows[i][1] for i in ids], np.float32))
        close = x @ x.T >= 0.93
        np.fill_diagonal(close, False)
        for i, n in zip(ids, close.sum(axis=1)):
            assert out[i].n_links <= n
            links, true = links + out[i].n_links, true + n
        if leaf_rows == 1024:
            for row, i in zip(close, ids):
                assert all(out[ids[j]].component_id == out[i].component_id for j in np.flatnonzero(row))
    assert links >= (true if leaf_rows == 1024 else 0.95 * true) > 1000
    assert out[len(rows) - 1].n_links == out[len(rows) - 2].n_links == 0
    assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())


def test_links_of_a_cluster_far_larger_than_a_leaf(spark):
    rng = np.random.default_rng(4)
    n, dim = 10_000, 64
    centre = rng.normal(size=dim)
    x = np.concatenate((centre + 0.2 * rng.normal(size=(n, dim)), rng.normal(size=(2 * n, dim)))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in vector_forest.near_vectors(vectors).collect()}
    unit = vector_forest.unit(x)
    close = np.array([np.count_nonzero(unit[i] @ unit.T >= 0.93) - 1 for i in range(0, n, 50)])
    found = np.array([out[i].n_links for i in range(0, n, 50)])
    assert close.mean() > 0.5 * n and (found <= close).all()
    assert found.sum() >= 0.99 * close.sum()
    assert {out[i].component_id for i in range(0, n, 50)} == {0}


def test_odd_vectors(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [None, 1.0], 1)]
    rows += [(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [1e300, 0.0], 1), (9, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (10, [1.0, 0.0], None)]
    out = vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert by[7] == (2, 7, True) and by[8] == (2, 7, False) and by[None] == (0, None, True)
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_forest.near_vectors(empty).count() == 0


def test_pipeline(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    after, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, after = after, stage(spark, after, folder).persist()
        kept.append({r.doc_id for r in after.select("doc_id").collect()})
        if name != "tokens":
            assert after.columns == docs.columns
    good = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept[0] == good
    groups = components({i: shingles(texts[i], 5) for i in good}, 80)
    assert kept[1] == {i for i in good if groups[i] == i}
    assert kept[2] == kept[1] and kept[3] <= kept[2] and kept[4] == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == kept[4]
    for rows in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, folder)
        rows.count()


def test_clashing_names(spark, real):
    """Extra columns called like the operators' own are kept or replaced, and nothing breaks."""
    import public_tokenizers

    from touchline.llm import bpe_trie, mixing, pii, secrets, token_counts, toxicity

    docs = real[0].limit(40)
    for c in ("_text", "_id", "_key", "_row", "_at", "_of", "_n", "_t", "n", "id", "v", "size", "kept", "n_tokens", "secrets", "severity", "copies"):
        docs = docs.withColumn(c, F.lit("x"))
    model = secrets.learn(docs)
    nothing = toxicity.Ordinal({}, np.array([5.0, 6.0, 7.0]))
    outs = [
        token_counts.token_counts(docs, public_tokenizers.path(token_counts.VOCABULARY)),
        bpe_trie.encode(docs, public_tokenizers.path(bpe_trie.VOCABULARY)),
        secrets.scan(docs, model),
        secrets.scan(docs, model, redact="?"),
        toxicity.severity(docs, nothing),
        pii.detect(docs),
        mixing.mix(docs),
        minhash_forest.near_duplicates(docs),
    ]
    for out in outs:
        assert out.count() == 40 and len(set(out.columns)) == len(out.columns)
    for out in (quality.keep_good(docs), minhash_forest.keep_one(docs), mixing.in_training_order(docs)):
        assert out.columns == docs.columns and 0 < out.count() <= 120


def test_texts_of_one_id_are_classes_of_their_own(spark):
    """Near copies of either text of a repeated id are found, whichever has the larger set."""
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 90)))
    rows = [(2, a), (2, b), (9, b + " more"), (7, "more " + a), (8, a), (5, "u v w x y z"), (5, "q r s t u v"), (6, "q r s t u v"), (5, "l m n o p q")]
    out = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(2, 2), (9, 2), (7, 2), (8, 2), (5, 5), (6, 5)}


@pytest.mark.parametrize("slim, full", [(4096, 1_000_000), (16, 3_000)])
def test_dense_regions_against_all_pairs(docs_of, monkeypatch, slim, full):
    """With hardly any neighbours looked at, regions find what the sorted orders missed, in blocks of any size."""
    rng = random.Random(slim)
    for name, value in (("NEIGHBOURS", 1), ("BEST", 1), ("FIRST", 1), ("SLIM_ROWS", slim), ("FULL_SHINGLES", full)):
        monkeypatch.setattr(minhash_forest, name, value)
    texts = []
    for g in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        texts += [edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.04])) for _ in range(120)]
    # A common opening, unlike bodies.
    texts += [" ".join(["all rights reserved"] * 4) + " " + " ".join(f"t{rng.randrange(9000)}" for _ in range(60)) for _ in range(60)]
    expected = components({i: shingles(t, 3) for i, t in enumerate(texts)}, 85)
    out = minhash_forest.near_duplicates(docs_of(texts), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in out} == expected
    assert 20 < len(set(expected.values())) < len(texts)
