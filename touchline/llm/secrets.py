"""Secret scan: candidate strings from whole texts, false positives removed by a random forest.

Candidates are strings of known key formats, values assigned to a telling name, and long mixed strings. The forest sees
their length, character classes and transitions, how much of them dictionary words cover, path signs, and the words beside
them. It is trained with Spark ML on labelled findings:

* findings of a bounded sample of documents, labelled where their form leaves no doubt (``label``); others are left out;
* examples made by rule (``examples``): ``MADE`` keys of every format and kind, and as many paths, numbers, identifiers and
  plain words, so that no format can be unlearnt and no small table leaves the forest with one kind. They weigh at least
  a third of the whole.

The dictionary and the character transitions come from all documents, by a combined count; a word is in the dictionary from
a share of the different texts on, so its size is bounded by the words of a text over that share, whatever the size of the
table. Scoring is a scan and a narrow map: the fitted trees (a few hundred nodes) travel with the function, and all
candidates of a batch are one matrix.

Never reported: bare hexadecimal strings and numbers without a telling name, and values of letters alone.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table, text_last

#: Documents the forest is trained on, texts a word of the dictionary must be in, at least and as a share.
TRAIN_DOCS, LEAST_TEXTS, LEAST_SHARE = 20_000, 3, 3 / 20_000
#: Digests of copied texts that are broadcast at most, words a task counts before it hands them on.
BROADCAST_IDS, HELD_WORDS = 1_000_000, 200_000
TREES, TREE_DEPTH, SEED = 20, 6, 7
SECRET_FROM = 0.5
#: Examples made of each format and kind, and the least share of the weight that all of them have.
MADE, MADE_SHARE = 40, 1 / 3

# Names that secrets are assigned to, and formats of keys.
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key")
FORMATS = {
    "cloud_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "code_host_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "chat_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "payment_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
# What a text must hold for a format to be in it, and the longest string a text may lack for a long one to be sought.
MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "k_test_", "eyJ")
LONG = 16
_KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?"
_FORMAT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()))
_BLOCK = re.compile(_KEY_BLOCK)
_ASSIGNED = re.compile(r"""(?ai)(?<![A-Za-z0-9])[A-Za-z0-9_-]{0,24}?(?:%s)["']?\s{0,3}[=:]\s{0,3}(["']?)([^\s"']{6,})""" % "|".join(NAMES))
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LONG)
_HINT = re.compile(r"(?ai)%s" % "|".join(NAMES))
_WORD = re.compile(r"[^\W\d_]{3,}")
KINDS = ("private_key", *FORMATS, "assigned", "long_string")
_RANK = {k: i for i, k in enumerate(KINDS)}


def _long_strings(text: str):
    """Long mixed strings. Only words that are long enough are looked into; they hold no white space."""
    at = 0
    for word in text.split():
        if len(word) < LONG:
            continue
        at = text.index(word, at)
        for m in _LONG.finditer(word):
            s = m.group()
            if any(c.isdigit() for c in s) and (any(c.isalpha() for c in s) or len(s) > 19) or (not s.islower() and not s.isupper() and not s.istitle()):
                yield at + m.start(), at + m.end(), "long_string"
        at += len(word)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping ``(start, end, kind)`` in code points, by start."""
    found: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        found += [(*m.span(), "private_key") for m in _BLOCK.finditer(text)]
    if any(m in text for m in MARKS):
        found += [(*m.span(), m.lastgroup) for m in _FORMAT.finditer(text)]
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(*m.span(2), "assigned") for m in _ASSIGNED.finditer(text)]
    found += _long_strings(text)
    # Of overlapping ones the more telling kind stays, in the order of KINDS, and of one kind the first.
    out: list[tuple[int, int, str]] = []
    for c in sorted(found, key=lambda c: (c[0], _RANK[c[2]])):
        if not out or out[-1][1] <= c[0]:
            out.append(c)
        elif _RANK[c[2]] < _RANK[out[-1][2]]:
            out[-1] = c
    return out


class Lexicon:
    """Dictionary and character transitions."""

    def __init__(self, words: set[str], bigrams: np.ndarray):
        self.words, self.bigrams = words, bigrams

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27

    @classmethod
    def of(cls, counts: list[tuple[str, int]]) -> Lexicon:
        pairs = np.ones((28, 28))
        for word, n in counts:
            s = [cls.symbol(c) for c in word]
            for a, b in zip(s, s[1:]):
                pairs[a, b] += n
        return cls({w for w, _ in counts}, np.log(pairs / pairs.sum(axis=1, keepdims=True)))

    def covered(self, value: str) -> float:
        """Share of the letters that dictionary words of four and more, taken greedily, cover."""
        low, i, held = value.lower(), 0, 0
        while i < len(low):
            for k in range(min(16, len(low) - i), 3, -1):
                if low[i : i + k] in self.words:
                    held += k
                    i += k
                    break
            else:
                i += 1
        return held / len(low) if low else 0.0

    def fluency(self, value: str) -> float:
        s = [self.symbol(c) for c in value.lower()]
        return float(np.mean([self.bigrams[a, b] for a, b in zip(s, s[1:])])) if len(s) > 1 else 0.0


def features(text: str, start: int, end: int, lexicon: Lexicon) -> list[float]:
    value = text[start:end]
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = Counter(kinds)
    letters = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in letters.values())
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    before, after = left.split()[-2:], right.split()[:2]
    known = lambda ws: sum(w.strip(".,;:!?\"'=()").lower() in lexicon.words for w in ws) / 2
    return [
        float(n),
        share["d"] / n,
        share["u"] / n,
        share["l"] / n,
        share["o"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        entropy,
        len(letters) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        lexicon.covered(value),
        lexicon.fluency(value),
        float(value.count("/")),
        float(value.count(".") + value.count("-") + value.count("_")),
        float(bool(re.search(r"\.[a-z]{2,4}$", value))),
        float(bool(_HINT.search(left))),
        float(left.rstrip("\"' ")[-1:] in ("=", ":") and left.rstrip("\"' ") != ""),
        known(before),
        known(after),
    ]


def label(kind: str, value: str, lexicon: Lexicon) -> int | None:
    """1 for a secret, 0 for a false positive, None where the form leaves doubt."""
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    covered = lexicon.covered(value)
    if kind == "assigned":
        return int(digits > 0 and covered < 0.5)
    if kind != "long_string":
        return 1
    if not letters or not digits or covered >= 0.5:
        return 0
    mixed = any(c.islower() for c in value) and any(c.isupper() for c in value)
    # Keys change between digits, capitals and small letters all the time; hexadecimal strings may be anything.
    return 1 if mixed and digits >= 3 and covered < 0.2 and len(set(value)) >= 14 and value.count("/") < 2 else None


def examples(lexicon: Lexicon) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, label)`` made by rule, the same at every run for one dictionary."""
    rng = random.Random(SEED)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    known = sorted(w for w in lexicon.words if w.isascii() and 4 <= len(w) <= 12)[:: max(1, len(lexicon.words) // 2000)]

    def word() -> str:
        """From the dictionary, or consonants and vowels in turn."""
        if known and rng.random() < 0.5:
            return rng.choice(known)
        return "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))

    alnum = upper + lower + digit
    secret = {
        "cloud_key": lambda: rng.choice(("AKIA", "ASIA")) + some(upper + digit, 16),
        "code_host_token": lambda: f"gh{rng.choice('pousr')}_{some(alnum, 36)}",
        "chat_token": lambda: f"xox{rng.choice('abprs')}-{some(digit, 11)}-{some(alnum, 24)}",
        "payment_key": lambda: f"{rng.choice('sr')}k_{rng.choice(('live', 'test'))}_{some(alnum, rng.randrange(16, 33))}",
        "web_token": lambda: f"eyJ{some(alnum, 20)}.eyJ{some(alnum, 40)}.{some(alnum + '_-', 43)}",
        "private_key": lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{some(alnum + '+/', 64)}\n{some(alnum + '+/', 64)}\n-----END RSA PRIVATE KEY-----",
        "long_string": lambda: some(alnum, rng.randrange(24, 65)),
    }
    shorter = {"assigned": lambda: some(rng.choice((alnum, lower + digit, upper + digit)), rng.randrange(6, 17)) + rng.choice(digit), "hex": lambda: some("abcdef" + digit, rng.choice((32, 40, 64)))}
    plain = {
        "number": lambda: some(digit, rng.randrange(16, 30)),
        "path": lambda: "/" + "/".join(word() for _ in range(rng.randrange(3, 6))) + rng.choice((".txt", ".html", "", "/v2")),
        "identifier": lambda: rng.choice(("_", "-", "")).join(word().title() if rng.random() < 0.5 else word() for _ in range(rng.randrange(3, 5))) + rng.choice(("", some(digit, 2))),
        "words": lambda: "".join(word() for _ in range(4)),
    }
    out = []

    def put(value: str, before: str, after: str, is_secret: int) -> None:
        left, right = " ".join(word() for _ in range(4)), " ".join(word() for _ in range(4))
        text = f"{left} {before}"
        out.append((f"{text}{value}{after} {right}", len(text), len(text) + len(value), is_secret))

    def assigned() -> tuple[str, str]:
        sign, quote = rng.choice((" = ", "=", ": ", ":")), rng.choice(('"', "'", ""))
        return f"{rng.choice(NAMES)}{sign}{quote}", quote

    for _ in range(MADE):
        for make in secret.values():
            put(make(), *(assigned() if rng.random() < 0.4 else rng.choice((("", ""), ("key ", ","), ("", ".")))), 1)
        for make in shorter.values():
            put(make(), *assigned(), 1)
        for make in plain.values():
            put(make(), "", rng.choice(("", ".", ",")), 0)
        for _ in range(4):
            put(rng.choice((word, plain["words"], lambda: word() + word()))(), *assigned(), 0)
    return out


def _training(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows, labels = [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                for start, end, kind in candidates(t):
                    is_secret = label(kind, t[start:end], lexicon)
                    if is_secret is not None:
                        rows.append(features(t, start, end, lexicon))
                        labels.append(float(is_secret))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], names=["x", "label"])

    return run


class Forest:
    """Trees as arrays: a node's feature (-1 at a leaf), threshold, children, and the chance of a secret."""

    def __init__(self, trees: list):
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees]

    @classmethod
    def of(cls, model) -> Forest:
        def walk(node, nodes):
            at = len(nodes)
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                nodes.append((-1, 0.0, at, at, stats[1] / sum(stats) if sum(stats) else 0.0))
                return at
            nodes.append(None)
            left, right = walk(node.leftChild(), nodes), walk(node.rightChild(), nodes)
            nodes[at] = (node.split().featureIndex(), node.split().threshold(), left, right, 0.0)
            return at

        trees = []
        for t in model.trees:
            trees.append([])
            walk(t._call_java("rootNode"), trees[-1])
        return cls(trees)

    def chances(self, rows: list[list[float]]) -> np.ndarray:
        """Mean over the trees for each row."""
        x, total = np.array(rows, float), np.zeros(len(rows))
        for feature, threshold, left, right, chance in self.trees if rows else ():
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(rows)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += chance[at]
        return total / max(1, len(self.trees))


def _different(docs: DataFrame, text: str) -> DataFrame:
    """``text``: each text once. Only texts that have copies are shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.alias("text")).withColumn("digest", F.struct(F.xxhash64("text"), F.xxhash64(F.reverse("text"))))
    copied = cut_lineage(rows.groupBy("digest").count().filter("count > 1").select("digest"))
    if copied.count() <= BROADCAST_IDS:
        copied = F.broadcast(copied)
    once = rows.join(copied, "digest", "left_anti").select("text")
    return once.union(rows.join(copied, "digest", "left_semi").select("text").distinct())


def _words(batches):
    """Texts that each word is in, and under a null word the number of texts."""

    def out(counts, texts):
        return pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), texts], pa.int64())], names=["word", "n"])

    found, texts = Counter(), 0
    for batch in batches:
        for x in batch.column("text"):
            found.update(set(_WORD.findall(x.as_py().lower())))
            texts += 1
            if len(found) >= HELD_WORDS:
                yield out(found, texts)
                found, texts = Counter(), 0
    yield out(found, texts)


def dictionary(docs: DataFrame, *, text: str = "text") -> Lexicon:
    """Words and character transitions of all documents (equal texts count once)."""
    counted = cut_lineage(_different(docs, text).mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    texts = counted.filter("word is null").first()["n"] if not counted.isEmpty() else 0
    held = counted.filter(F.col("word").isNotNull() & (F.col("n") >= max(LEAST_TEXTS, LEAST_SHARE * texts)))
    return Lexicon.of([tuple(r) for r in held.orderBy(F.desc("n"), "word").collect()])


def learn(docs: DataFrame, *, text: str = "text", rows: int = TRAIN_DOCS) -> tuple[Lexicon, Forest]:
    """Dictionary of all documents, and forest from about ``rows`` of them, drawn by a hash of the text (equal texts count once)."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = docs.count()
    drawn = docs.select(t.alias("text")).filter(F.xxhash64("text").cast("double") / 2.0**64 + 0.5 < rows / max(1, n)).dropDuplicates(["text"])
    drawn = cut_lineage(drawn)
    lexicon = dictionary(docs, text=text)
    found = cut_lineage(drawn.mapInArrow(_training(lexicon), "x array<double>, label double"))
    made = [(features(t, a, b, lexicon), float(y)) for t, a, b, y in examples(lexicon)]
    weight = max(1.0, found.count() * MADE_SHARE / (1 - MADE_SHARE) / len(made))
    every = found.withColumn("weight", F.lit(1.0)).union(docs.sparkSession.createDataFrame(made, found.schema).withColumn("weight", F.lit(weight)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, weightCol="weight", minInstancesPerNode=1)
    return lexicon, Forest.of(forest.fit(every.select(array_to_vector("x").alias("features"), "label", "weight")))


def find(texts: list[str], lexicon: Lexicon, forest: Forest, secret_from: float = SECRET_FROM) -> list[tuple[int, list[tuple[int, int, str]]]]:
    """For each text the number of candidates, and those the forest takes for secrets."""
    met = [candidates(t) for t in texts]
    chances = forest.chances([features(t, c[0], c[1], lexicon) for t, cs in zip(texts, met) for c in cs])
    out, at = [], 0
    for cs in met:
        out.append((len(cs), [c for c, p in zip(cs, chances[at : at + len(cs)]) if p >= secret_from]))
        at += len(cs)
    return out


def scan(docs: DataFrame, model: tuple[Lexicon, Forest], *, text: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """``keep`` columns, ``n_candidates``, ``n_secrets`` and ``secrets``, an array of ``<start, end, kind>``.

    With ``redact`` it gives the columns of ``docs`` alone, each secret in the text replaced by that mark. Null texts
    hold no secret and stay null, empty ones stay empty. Positions are code points, the end exclusive; texts and candidates
    are read whole, however long. Repeated rows get the same answer each, an empty table gives an empty one, and columns
    called like the new ones are replaced by them.
    """
    lexicon, forest = model
    names = docs.columns
    if redact is not None:

        def clean(batches):
            at = names.index(text)
            for batch in batches:
                out = batch.column(at).to_pylist()
                for i, (_, spans) in enumerate(find([t or "" for t in out], lexicon, forest)):
                    for start, end, _ in reversed(spans):
                        out[i] = out[i][:start] + redact + out[i][end:]
                columns = [pa.array(out, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return docs.mapInArrow(clean, docs.schema)

    made = ("n_candidates", "n_secrets", "secrets")
    keep = [c for c in (names if keep is None else keep) if c != text and c not in made]
    picked, schema = text_last(docs, keep, text, dict(zip(made, ("long", "long", "array<struct<start:int,end:int,kind:string>>"))))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            *rest, texts = batch.columns
            found = find([t.as_py() or "" for t in texts], lexicon, forest)
            listed = pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f] for _, f in found], kind)
            counts = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest, *counts, listed], names=[*batch.schema.names[:-1], *made])

    return picked.mapInArrow(run, schema)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, learn(docs), keep=["doc_id"])
    listed = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_candidates", "n_secrets", listed.alias("spans"), (F.col("n_secrets") > 0).alias("has_secret"))
