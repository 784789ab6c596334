"""Near duplicates of texts by an LSH forest over MinHash signatures.

A document is its set of word shingles. A signature is cut into as many slices as the forest has trees; a tree is the
sorted order of one slice. Documents that stand close in some order and share a long enough prefix are candidates: in a
thin region neighbours share only the least prefix, in a dense one the nearest share far more, so depth adapts to each
region. Candidates that the whole signature makes plausible are confirmed on their full sets.

Steps, all on narrow tables but the first and the confirmation:

1. one pass over the texts: set size, a digest of the set, and the signature (checkpointed);
2. documents with one set become one class, by a map-side combined minimum;
3. every class goes into each tree; a range shuffle by (tree, slice, id) gives the sorted orders. The id is part of the
   order, so a dense region is cut at partition borders like any other; the rows around each border are compared once
   more;
4. each class's most alike candidates are confirmed first and components are formed; then all other candidates whose
   ends are still apart. A link inside a component changes nothing, so nothing is lost that the forest has found;
5. components by alternating star contraction;
6. dense regions: in a run of equal least prefixes that is larger than what a row is paired with, the forest has not met
   all pairs. Signatures alone go into such runs, block by block: rows outside the run's largest component against all.
   Rows that may link across components, by whatever chain of such pairs, form a region. Then the full sets of a region's
   rows meet once, whatever the number of trees: rows outside its largest component against all, in blocks of a bounded
   number of shingles, each block giving the links that unite its components. Comparisons grow with the square of a
   region, and so do the copies of its rows once it is larger than a block; what comes out does not.

A hub or a group of copies never meets in one task: joins have one row per key on one side, and sums are combined first.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SEPARATORS, least_reachable, ranked, release, settle, spare, table

#: The forest: trees, hashes in a tree's slice, hashes that neighbours must share, neighbours looked at on each side.
TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 20, 8, 3, 16
#: Hashes of the slice that two neighbours must have in common, those of the prefix included.
LEAST_COMMON = 4
#: Neighbours that a class is paired with in each tree, and candidates of a class that are confirmed first.
BEST, FIRST = 6, 4
#: Candidates whose signatures agree less than this share of the threshold are not confirmed. With 160 hashes a pair at
#: 0.85 falls below with a chance of about 1e-6, one at 0.8 of 4e-6.
PLAUSIBLE = 0.84
WORDS, PERCENT = 5, 80
#: Ids that are broadcast at most; beyond that texts meet them in a shuffled join.
BROADCAST_IDS = 1_000_000
#: Rows of a side of a block of signatures, shingles of a side of a block of full sets.
SLIM_ROWS, FULL_SHINGLES = 4096, 1_000_000
#: Rows of a partition of a settled table that holds signatures.
WIDE_ROWS = 20_000
#: Bytes of text hashed together.
RUN_BYTES = 1 << 20

_WRAP = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in SEPARATORS]] = True
_random = np.random.default_rng(20_240_607)
_BYTE = _random.integers(0, _WRAP, 256, dtype=np.uint64, endpoint=True)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_XOR = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64; they grow with the longest run."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def shingles(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of several texts, and where each text's begin (one more entry than texts).

    ``raw`` holds the texts' UTF-8 bytes one after another, text i from ``bounds[i]`` on. A word's hash is a polynomial
    over random values of its bytes; all are had at once from running sums. A text of fewer words than ``width`` is one
    shingle.
    """
    texts = len(bounds) - 1
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    word = ~_GAP[raw]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begins = np.flatnonzero(word & (first[:n] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (first[1:] | np.concatenate((~word[1:], [True])))) + 1
    up, down = _POWERS.take(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_BYTE[raw] * up)))
    hashed = _mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    at = np.searchsorted(begins, bounds)  # first word of each text
    counts = np.diff(at)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(made)))
    # The first word of each shingle, and the words after it that belong to it.
    owner = np.repeat(np.arange(texts), made)
    head = at[owner] + np.arange(starts[-1]) - starts[owner]
    last = at[owner + 1]
    total = np.zeros(len(head), np.uint64)
    for j in range(width):
        inside = head + j < last
        value = hashed[np.minimum(head + j, len(hashed) - 1)] if len(hashed) else total
        total = (total + np.where(inside, value, np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93 | 1)
    return _mix(total), starts


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts x hashes: 16 bits of the least permuted shingle; texts without shingles must be left out."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, len(_XOR)), np.uint16)
    for k in range(len(_XOR)):
        # Big-endian order of bytes makes slices sort by hash.
        out[:, k] = np.minimum.reduceat((short ^ _XOR[k]) * _TIMES[k], starts[:-1]).astype(np.uint16)
    return out


def _text_runs(batch):
    """Slices of a batch of about RUN_BYTES with their raw bytes and bounds; the text is the last column."""
    text = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1)
        j = min(j, len(text))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _digest(own: np.ndarray) -> tuple[np.int64, np.int64]:
    """128 bits that name a set of shingles."""
    return own.sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(_mix(own + np.uint64(1))).view(np.int64)


def _profiles(width: int):
    def run(batches):
        for batch in batches:
            for i, j, raw, bounds in _text_runs(batch):
                hashes, starts = shingles(raw, bounds, width)
                sizes, adds, xors = (np.zeros(j - i, np.int64) for _ in range(3))
                for k in range(j - i):
                    own = np.unique(hashes[starts[k] : starts[k + 1]])
                    sizes[k] = len(own)
                    adds[k], xors[k] = _digest(own)
                some = np.flatnonzero(sizes)
                found: list[bytes | None] = [None] * (j - i)
                if len(some):
                    slim = signatures(hashes, np.append(starts[some], starts[-1])).astype(">u2")
                    for k, row in zip(some, slim):
                        found[k] = row.tobytes()
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(adds), pa.array(xors), pa.array(found, pa.binary())],
                    names=["id", "n", "d1", "d2", "signature"],
                )

    return run


def profiles(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    picked = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("_text"))
    return picked.mapInArrow(_profiles(width), "id long, n long, d1 long, d2 long, signature binary")


def _neighbours(batches):
    """Candidate pairs of sorted rows, and the rows near the partition's borders.

    Rows: key (tree, slice) and id. Out: (pair, a, b), or (head or tail, partition, key, id).
    """
    schema = pa.schema([("what", pa.string()), ("part", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.binary())])
    part = TaskContext.get().partitionId()

    def out(what, a, b=None, k=None):
        n = len(a)
        b = pa.nulls(n, pa.int64()) if b is None else pa.array(b)
        k = pa.nulls(n, pa.binary()) if k is None else pa.array([x.tobytes() for x in k], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([what] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(a), b, k], schema=schema)

    keys, ids = np.zeros((0, 1 + 2 * DEPTH), np.uint8), np.zeros(0, np.int64)
    head, done = 0, 0  # rows of the border given out; rows at the front whose neighbours have been looked at
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        i = np.asarray(batch.column("id"))
        if head < NEIGHBOURS:
            yield out("head", i[: NEIGHBOURS - head], k=k[: NEIGHBOURS - head])
            head += min(len(i), NEIGHBOURS - head)
        keys, ids = np.concatenate((keys, k)), np.concatenate((ids, i))
        upto = max(done, len(ids) - NEIGHBOURS)
        yield out("pair", *close(keys, ids, done, upto))
        drop = max(0, upto - NEIGHBOURS)
        keys, ids, done = keys[drop:], ids[drop:], upto - drop
    yield out("pair", *close(keys, ids, done, len(ids)))
    yield out("tail", ids[-NEIGHBOURS:], k=keys[-NEIGHBOURS:])


def close(keys: np.ndarray, ids: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the sorted rows from ``first`` to ``last`` with their likest neighbours.

    A row looks at NEIGHBOURS rows on each side, of which those count that share the least prefix. It is paired with the
    BEST of them by the number of hashes their slices have in common. So a cluster of any size gives a few pairs per row.
    """
    prefix = np.zeros((len(ids), 8), np.uint8)
    prefix[:, : 1 + 2 * LEAST_DEPTH] = keys[:, : 1 + 2 * LEAST_DEPTH]
    prefix = prefix.view(np.uint64)[:, 0]
    hashes = np.ascontiguousarray(keys[:, 1:]).view(np.uint16)
    same = prefix[1:] == prefix[:-1]
    rows = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    rows = rows[(rows >= first) & (rows < last)]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps = np.array([s for k in range(1, NEIGHBOURS + 1) for s in (-k, k)])  # nearest first, as ties go to them
    common = np.zeros((len(rows), len(steps)), np.int8)
    for j, step in enumerate(steps):
        other = rows + step
        inside = np.flatnonzero((other >= 0) & (other < len(ids)))
        inside = inside[prefix[rows[inside]] == prefix[other[inside]]]
        common[inside, j] = (hashes[rows[inside]] == hashes[other[inside]]).sum(axis=1)
    best = np.argsort(-common, axis=1, kind="stable")[:, :BEST]
    held = np.take_along_axis(common, best, axis=1) >= LEAST_COMMON
    a, b = ids[np.repeat(rows, held.sum(axis=1))], ids[(rows[:, None] + steps[best])[held]]
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return pairs[0], pairs[1]


def _across(batch: pa.Table) -> pa.Table:
    """Pairs across one border: its rows are the last of one partition and the first of the next."""
    batch = batch.sort_by([("key", "ascending"), ("a", "ascending")])
    keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    a, b = close(keys, np.asarray(batch.column("a")), 0, batch.num_rows)
    return pa.table({"a": a, "b": b})


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of classes (``id, signature``) that are neighbours in some tree."""
    width = 2 * DEPTH
    trees = F.explode(F.array(*[F.concat(F.lit(bytes([t])), F.substring("signature", 1 + t * width, width)) for t in range(TREES)]))
    ordered = classes.select(trees.alias("key"), "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = settle(ordered.mapInArrow(_neighbours, "what string, part int, a long, b long, key binary"))
    # One row per partition, few enough for the driver: which one comes before which.
    parts = sorted(r[0] for r in found.filter("what = 'head'").select("part").distinct().collect())
    before = F.create_map(*itertools.chain(*[(F.lit(b), F.lit(a)) for a, b in zip(parts, parts[1:])])) if len(parts) > 1 else None
    pairs = found.filter("what = 'pair'").select("a", "b")
    if before is not None:
        of = F.when(F.col("what") == "tail", F.col("part")).otherwise(F.try_element_at(before, F.col("part")))
        border = found.filter("what <> 'pair'").withColumn("border", of)
        pairs = pairs.union(border.filter("border is not null").select("border", "key", "a").groupBy("border").applyInArrow(_across, "a long, b long"))
    return pairs.filter("a <> b").distinct()


def _agreement(batches):
    """Share of equal hashes of two signatures."""
    for batch in batches:
        s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("s", "t"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((s == t).mean(axis=1) if batch.num_rows else np.zeros(0))], names=["a", "b", "alike"])


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, alike``: pairs whose set sizes allow the similarity and whose signatures suggest it."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("t"))
    met = pairs.join(left, "a").join(right, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    scored = met.select("a", "b", "s", "t").mapInArrow(_agreement, "a long, b long, alike double")
    return scored.filter(F.col("alike") >= PLAUSIBLE * percent / 100)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for i, j, raw, bounds in _text_runs(batch):
                hashes, starts = shingles(raw, bounds, width)
                own = [np.unique(hashes[starts[k] : starts[k + 1]]) for k in range(j - i)]
                named = [pa.array(d, pa.int64()) for d in zip(*(_digest(x) for x in own))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *named, pa.array([x.tobytes() for x in own], pa.binary())], names=["doc", "d1", "d2", "own"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s"), batch.column("t")):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``id, own``: the full set of each class in ``ids``. Only the texts of their first documents are read on."""
    wanted = settle(classes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "doc", "d1", "d2"))
    small = wanted.count() <= BROADCAST_IDS
    held = wanted.select("doc").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("_text"))
    texts = texts.join(F.broadcast(held) if small else held, "doc", "left_semi")
    sets = texts.mapInArrow(_sets(width), "doc long, d1 long, d2 long, own binary")
    met = sets.join(F.broadcast(wanted) if small else wanted, ["doc", "d1", "d2"])
    # Repeated rows have one set.
    out = cut_lineage(met.groupBy("id").agg(F.max("own").alias("own")))
    release(wanted)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("t"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirm(percent), "a long, b long")


def mixed_runs(members: DataFrame, block: int, least: int = 2) -> DataFrame:
    """``key, main, l, r``: groups of ``least`` rows and several components.

    ``main`` is the component with the most weight; ``l`` and ``r`` are the blocks of the rows outside it and of all rows,
    so many that a block weighs about ``block``.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
    runs = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("w", "component")).alias("m"), F.count("*").alias("parts"))
    runs = runs.filter((F.col("parts") > 1) & (F.col("c") >= least))
    blocks = lambda w: F.ceil(w / block).cast("int")
    return runs.select("key", F.col("m.component").alias("main"), blocks(F.col("w") - F.col("m.w")).alias("l"), blocks(F.col("w")).alias("r"))


def cells(members: DataFrame, runs: DataFrame):
    """``members`` grouped by the cells they belong to: block i of the rows outside ``main`` against block j of all."""
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_IDS else runs
    met = members.join(runs, "key").withColumn("apart", F.col("component") != F.col("main"))
    met = met.withColumns({"own_i": F.pmod(F.xxhash64("id", F.lit(1)), "l").cast("int"), "own_j": F.pmod(F.xxhash64("id", F.lit(2)), "r").cast("int")})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = F.transform(upto("l"), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j"), F.lit(False).alias("left")))
    left = F.transform(upto("r"), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    spots = F.explode(F.when(F.col("apart"), F.concat(right, left)).otherwise(right))
    # A cell's name is one column: grouped by key and more, Spark would leave a run where a join by key has put it.
    cell = F.concat_ws("/", F.hex("key"), "_at.i", "_at.j").alias("cell")
    return met.withColumn("_at", spots).select(cell, "_at.left", "apart", *members.columns).groupBy("cell")


class _Cell:
    """One cell's rows, and for each left row the right rows it may link with."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        side = np.asarray(rows.column("left"))
        self.sides = [np.flatnonzero(side), np.flatnonzero(~side)]
        self.ids, self.n = np.asarray(rows.column("id")), np.asarray(rows.column("n"))
        self.apart = np.asarray(rows.column("apart"))
        _, self.part = np.unique(np.asarray(rows.column("component")), return_inverse=True)
        self.hashes = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(rows.num_rows, -1)

    def partners(self, a: int, group: np.ndarray) -> np.ndarray:
        """Right rows of another component and group than row ``a`` whose size and signature allow a link.

        Of two rows outside the main component each is the left one once; the smaller id does the work.
        """
        r = self.sides[1]
        r = r[(group[r] != group[a]) & (self.part[r] != self.part[a]) & (~self.apart[r] | (self.ids[r] > self.ids[a]))]
        r = r[100 * np.minimum(self.n[r], self.n[a]) >= self.percent * np.maximum(self.n[r], self.n[a])]
        return r[(self.hashes[r] == self.hashes[a]).mean(axis=1) >= PLAUSIBLE * self.percent / 100] if len(r) else r


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _may_link(percent: int):
    """Rows of a cell which may link, by whatever chain of such pairs: each with the least id of its chain.

    The least ids of a region are few, so cells of different trees give much the same pairs.
    """

    def run(rows):
        cell = _Cell(rows, percent)
        # A row may stand on both sides.
        _, group = np.unique(cell.ids, return_inverse=True)
        met = np.zeros(len(group), bool)
        for a in cell.sides[0]:
            r = cell.partners(a, group)
            if len(r):
                met[r] = met[a] = True
                group[np.isin(group, group[r])] = group[a]
        group, ids = group[met], cell.ids[met]
        order = np.lexsort((ids, group))
        group, ids = group[order], ids[order]
        least = ids[np.searchsorted(group, group)]
        return _links([(ids[ids != least], least[ids != least])])

    return run


def _unite(percent: int):
    """Links on full sets that unite components of a cell."""

    def run(rows):
        cell = _Cell(rows, percent)
        own = [np.frombuffer(x.as_buffer(), np.uint64) for c in rows.column("own").chunks for x in c]
        _, places = np.unique(np.concatenate(own), return_inverse=True)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        own = [places[a:b] for a, b in zip(bounds, bounds[1:])]
        flag, found = np.zeros(int(places.max()) + 1, np.int64), []
        for a in cell.sides[0]:
            r = cell.partners(a, cell.part)
            if not len(r):
                continue
            flag[own[a]] = 1
            lengths = np.array([len(own[b]) for b in r])
            both = np.add.reduceat(flag[np.concatenate([own[b] for b in r])], np.cumsum(lengths) - lengths)
            flag[own[a]] = 0
            r = r[100 * both >= percent * (len(own[a]) + lengths - both)]
            parts, first = np.unique(cell.part[r], return_index=True)
            if len(r):
                found.append((np.full(len(first), cell.ids[a]), cell.ids[r[first]]))
                cell.part[np.isin(cell.part, parts)] = cell.part[a]
        return _links(found)

    return run


def dense_links(classes: DataFrame, parts: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between components that share a run of equal least prefixes."""
    step = 2 * DEPTH
    keys = [F.concat(F.lit(bytes([t])), F.substring("signature", 1 + t * step, 2 * LEAST_DEPTH)) for t in range(TREES)]
    placed = classes.select("id", "n", "signature").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = settle(placed, WIDE_ROWS)
    slim = placed.select(F.explode(F.array(*keys)).alias("key"), "id", "component", F.lit(1).alias("weight"))
    # Up to BEST neighbours of a row have all been candidates.
    runs = settle(mixed_runs(slim, SLIM_ROWS, BEST + 2))
    if runs.isEmpty():
        return classes.sparkSession.createDataFrame([], "a long, b long")
    few = F.broadcast(runs.select("key")) if runs.count() <= BROADCAST_IDS else runs.select("key")
    members = placed.select(F.explode(F.array(*keys)).alias("key"), "id", "component", "n", "signature").join(few, "key", "left_semi")
    hoped = settle(cells(members, runs).applyInArrow(_may_link(percent), "a long, b long").distinct())
    regions = settle(least_reachable(hoped))
    members = regions.select("id", F.hex("component").alias("key")).join(placed, "id").withColumn("weight", F.col("n"))
    groups = settle(mixed_runs(members, FULL_SHINGLES))
    sets = full_sets(regions, classes, docs, doc_id, text, width)
    out = settle(cells(members.drop("weight").join(sets, "id"), groups).applyInArrow(_unite(percent), "a long, b long").distinct())
    release(placed, runs, hoped, regions, groups, sets)
    return out


def named_classes(named: DataFrame) -> DataFrame:
    """``id, doc, n, d1, d2, signature``: a row per different set, ``doc`` its smallest document id.

    ``id`` is the class's name, ``doc`` where that names no other class; where one id has several texts, its other classes
    get numbers below all ids.
    """
    classes = named.groupBy("n", "d1", "d2").agg(F.min("id").alias("doc"), F.min("signature").alias("signature"))
    classes = settle(classes.withColumn("id", F.col("doc")), WIDE_ROWS)
    shared = classes.groupBy("doc").count().filter("count > 1").select("doc")
    if shared.isEmpty():
        return classes
    lowest = classes.agg(F.min("doc")).first()[0]
    several = classes.join(shared, "doc", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("n", "d1", "d2"))
    several = several.withColumn("_nth", nth)
    others = ranked(several.filter("_nth > 1").select("doc", "n", "d1", "d2"), [F.col(c) for c in ("doc", "n", "d1", "d2")], "_place")
    made = classes.join(others, ["doc", "n", "d1", "d2"], "left").withColumn("id", F.when(F.col("_place").isNull(), F.col("doc")).otherwise(lowest - F.col("_place")))
    return settle(made.select(*classes.columns), WIDE_ROWS)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents with 100 * |intersection| >= percent * |union| of their shingle sets are linked; ``component_id`` is the
    smallest id that links reach. A text of fewer words than a shingle is one shingle; null, empty and blank texts have
    none and link with nothing. Repeated rows have one id and one answer; of rows with one id and different texts, the
    id links what either links. A null id links with nothing, its component is null and it is kept. An empty table
    gives an empty one.
    """
    rows = settle(profiles(docs, doc_id, text, words), WIDE_ROWS)
    named = rows.filter("id is not null and n > 0")
    classes = named_classes(named)
    # Ids that stand in several classes (one id, different texts) tie them together.
    twice = named.groupBy("id").agg(F.count_distinct("n", "d1", "d2").alias("c")).filter("c > 1").select("id")
    tied = named.join(twice, "id", "left_semi").join(classes.select("n", "d1", "d2", F.col("id").alias("class")), ["n", "d1", "d2"])
    least = tied.groupBy("id").agg(F.min("class").alias("b"))
    ties = tied.join(least, "id").select(F.col("class").alias("a"), "b").filter("a <> b")

    met = candidates(classes)
    found = settle(plausible(met, classes, percent))
    sets = full_sets(found.select(F.explode(F.array("a", "b")).alias("id")), classes, docs, doc_id, text, words)
    ends = found.union(found.select("b", "a", "alike"))
    # A class has a bounded number of candidates: BEST in each tree, and those it is best for.
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("alike"), "b"))
    best = ends.withColumn("rank", rank).filter(F.col("rank") <= FIRST)
    first = settle(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = settle(confirmed(first, sets, percent).union(ties))
    parts = settle(least_reachable(links))
    named_a = parts.select(F.col("id").alias("a"), F.col("component").alias("p"))
    named_b = parts.select(F.col("id").alias("b"), F.col("component").alias("q"))
    rest = found.join(first, ["a", "b"], "left_anti").join(named_a, "a", "left").join(named_b, "b", "left")
    rest = rest.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")
    more = settle(confirmed(rest, sets, percent))
    release(found, sets, first)
    links = links.union(more)
    if not more.isEmpty():
        parts = settle(least_reachable(links))
    more = dense_links(classes, parts, docs, doc_id, text, words, percent)
    if not more.isEmpty():
        parts = settle(least_reachable(links.union(more)))

    if not twice.isEmpty():
        # A class whose first document's id names another class too has a made-up name: the smallest id is looked up.
        placed = classes.join(parts, "id", "left").select(F.coalesce("component", "id").alias("component"), "id", "doc")
        least = placed.groupBy("component").agg(F.min("doc").alias("least"))
        parts = cut_lineage(placed.join(least, "component").select("id", F.col("least").alias("component")))
    classes = classes.join(parts, "id", "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    linked = named.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("id", "n", "component")
    alone = rows.filter("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    out = linked.union(alone)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one left of each component, and one of repeated rows; columns as they are."""
    judged = cut_lineage(near_duplicates(docs, doc_id=doc_id, text=text, **options).filter("doc_id is not null"))
    name = spare("_id", docs)
    gone = judged.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    twice = judged.filter("kept").groupBy(F.col("doc_id").alias(name)).count().filter("count > 1").select(name)

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    here = F.col(doc_id) == F.col(name)
    left = docs.join(small(gone), here, "left_anti")
    if twice.isEmpty():
        return left
    twice = small(twice)
    return left.join(twice, here, "left_anti").union(left.join(twice, here, "left_semi").dropDuplicates([doc_id]))


def op10_minhash_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
