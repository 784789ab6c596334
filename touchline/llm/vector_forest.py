"""Near duplicates of vectors: a forest of random-projection trees with spill.

A tree splits the vectors of a label at the median of their projection on a random direction, again and again, until a
node is small. Vectors near the median go both ways (spill), so close vectors are rarely parted, and there are many
trees. Inside each leaf all vectors are compared by matrix products, and links are exact cosines.

All steps are Spark jobs over rows (tree, node, vector):

* Equal vectors of a label form one class with a count, by a map-side combined aggregate; only classes enter the trees.
* In each round every node above the leaf size fits the thresholds of its next few levels on a bounded sample of its own
  rows (``FIT_ROWS`` expected, chosen by hash), then all its rows go down. Nodes are as many as they need to be; no node is
  ever held in one task, and the thresholds, one row per node, reach the rows by a join that Spark can split.
* A pair met in several leaves is counted in the first of them: each row carries its list of leaves (a few per tree).
  A leaf emits a link count per vector and one edge per vector to its local component, so no rows grow with the square
  of a cluster.
* A node whose sampled rows are mutually close (``TIGHT`` of their pairs are links) is not split, as that would part a
  cluster again and again: it is a leaf of any size, whose rows are dealt to blocks by a hash and compared block by block,
  each pair of blocks in a task of its own. At most 1 / TIGHT pairs are compared for each link. If a label as a whole is
  such a node, one tree is enough and has every link.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import least_reachable, table

TREES = 8
#: Rows a leaf may have, share of rows on each side of the median that go both ways, rows a node's thresholds are fitted on.
LEAF_ROWS, SPILL, FIT_ROWS = 1024, 0.05, 1024
#: Levels a node goes down in one round, and rounds.
LEVELS, ROUNDS = 4, 16
#: Share of linked pairs in a sample from which on a node is compared whole, rows the sample must have, rows of a block.
TIGHT, TIGHT_ROWS, BLOCK_ROWS = 0.05, 32, 4096
COSINE = 0.93
SEED = 1234
_BLOCK = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaled by the largest part first, so no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(len(column), -1))


def _direction(tree: int, node: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree, node]).normal(size=dim)


def _descend(x: np.ndarray, tree: int, node: int, levels: int, threshold):
    """Rows of each node ``levels`` further down; ``threshold(place, projection, rows)`` gives the band that goes both ways."""
    nodes = [(1, np.arange(len(x)))]
    for _ in range(levels):
        below = []
        for place, rows in nodes:
            p = x[rows] @ _direction(tree, (node << (place.bit_length() - 1)) + place - (1 << (place.bit_length() - 1)), x.shape[1])
            low, high = threshold(place, p, rows)
            below += [(2 * place, rows[p <= high]), (2 * place + 1, rows[p >= low])]
        nodes = below
    return [((node << levels) + place - (1 << levels), rows) for place, rows in nodes]


def _tight(x: np.ndarray, cosine: float) -> bool:
    """Whether so many pairs of the sampled rows are links that splitting would part them."""
    n = len(x)
    return n >= TIGHT_ROWS and ((x @ x.T >= cosine).sum() - n) >= TIGHT * n * (n - 1)


def _fit(key, rows: pa.Table, cosine: float) -> pa.Table:
    """Thresholds of a node's next levels, from a sample of its rows, and whether it is to stay whole."""
    tree, node, levels = (rows.column(c)[0].as_py() for c in ("tree", "node", "levels"))
    bands = np.full((1 << levels, 2), np.nan)
    x = _matrix(rows.column("v"))
    whole = _tight(x, cosine)

    def band(place, p, here):
        if place > 1 and _tight(x[here], cosine):
            # All go left together; the next round looks at them with a sample of their own.
            bands[place] = np.inf
        elif len(p):
            bands[place] = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        return bands[place]

    if not whole:
        _descend(x, tree, node, levels, band)
    # A place the sample did not reach sends its rows to the left.
    bands[np.isnan(bands)] = np.inf
    return pa.table({"grp": [key[0]], "tree": pa.array([tree], pa.int32()), "node": [node], "levels": pa.array([levels], pa.int32()), "bands": [bands.ravel().tolist()], "whole": [whole]})


def _go_down(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("v"))
        grp, tree, node = (np.asarray(batch.column(c)) for c in ("grp", "tree", "node"))
        levels = np.asarray(batch.column("levels"))
        order = np.lexsort((node, tree, grp))
        new = np.flatnonzero(np.r_[True, (grp[order][1:] != grp[order][:-1]) | (tree[order][1:] != tree[order][:-1]) | (node[order][1:] != node[order][:-1])])
        picked, nodes = [], []
        for rows in np.split(order, new[1:]):
            i = int(rows[0])
            bands = np.asarray(batch.column("bands")[i].as_py()).reshape(-1, 2)
            for below, own in _descend(x[rows], int(tree[i]), int(node[i]), int(levels[i]), lambda place, _, __, b=bands: b[place]):
                picked.append(rows[own])
                nodes.append(np.full(len(own), below, np.int64))
        take = pa.array(np.concatenate(picked))
        yield pa.RecordBatch.from_arrays(
            [batch.column("grp").take(take), batch.column("tree").take(take), pa.array(np.concatenate(nodes)), batch.column("id").take(take), batch.column("v").take(take)],
            names=["grp", "tree", "node", "id", "v"],
        )


def leaves(classes: DataFrame, trees: int = TREES, leaf_rows: int = LEAF_ROWS, cosine: float = COSINE) -> DataFrame:
    """``grp, tree, node, id, v, blocks``: each class in its leaves, from ``grp, id, v``; a whole node has several blocks."""
    kind = classes.schema["v"].dataType.simpleString()
    schema = f"grp long, tree int, node long, id long, v {kind}"
    rows = classes.select("grp", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), F.lit(1).cast("long").alias("node"), "id", "v")
    done = None
    spot = ["grp", "tree", "node"]
    for turn in range(ROUNDS):
        sizes = rows.groupBy(*spot).count()
        depth = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("count") / (0.8 * leaf_rows))).cast("int")))
        large = cut_lineage(sizes.filter(F.col("count") > leaf_rows).select(*spot, "count", depth.alias("levels")))
        if large.isEmpty():
            break
        small = rows.join(large.select(*spot), spot, "left_anti").select(*rows.columns, F.lit(1).alias("blocks"))
        done = small if done is None else done.union(small)
        going = rows.join(large, spot)
        chance = F.lit(float(FIT_ROWS)) / F.col("count")
        drawn = F.xxhash64("id", "tree", "node").cast("double") / 2.0**64 + 0.5 < chance
        bands = going.filter(drawn).select(*spot, "id", "v", "levels").groupBy(*spot).applyInArrow(
            lambda key, t: _fit((key[0].as_py(),), t, cosine), "grp long, tree int, node long, levels int, bands array<double>, whole boolean"
        )
        bands = cut_lineage(bands)
        blocks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")
        whole = large.join(bands.filter("whole").select(*spot), spot).select(*spot, blocks)
        if turn == 0:
            # A label that is compared whole in one tree needs no other.
            full = whole.groupBy("grp").agg(F.min("tree").alias("one"))
            rows = rows.join(full, "grp", "left").filter("one is null or tree = one").drop("one").select("grp", "tree", "node", "id", "v")
            small = done = rows.join(large.select(*spot), spot, "left_anti").select(*rows.columns, F.lit(1).alias("blocks"))
        done = done.union(rows.join(whole, spot).select(*rows.columns, "blocks"))
        rows = cut_lineage(rows.join(bands.filter("not whole"), spot).drop("whole").mapInArrow(_go_down, schema))
    rows = rows.withColumn("blocks", F.lit(1))
    return rows if done is None else done.union(rows)


def cells(placed: DataFrame):
    """The rows of leaves grouped into pairs of blocks ``i <= j``; a leaf of one block is one cell."""
    met = placed.withColumn("own", F.pmod(F.xxhash64("id", F.lit(SEED)), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    return met.withColumn("_at", F.explode(others)).select("*", "_at.i", "_at.j").drop("_at", "blocks").groupBy("grp", "tree", "node", "i", "j")


def _compare(cosine: float):
    def run(leaf: pa.Table) -> pa.Table:
        x = _matrix(leaf.column("v"))
        ids, times = np.asarray(leaf.column("id")), np.asarray(leaf.column("times"))
        here = (leaf.column("tree")[0].as_py(), leaf.column("node")[0].as_py())
        # Rows that met in an earlier leaf, by that leaf.
        earlier: dict[tuple, list[int]] = {}
        for i, homes in enumerate(leaf.column("homes").to_pylist()):
            for h in homes:
                if (spot := (h["tree"], h["node"])) < here:
                    earlier.setdefault(spot, []).append(i)
        n = len(ids)
        met = [np.isin(np.arange(n), rows) for rows in earlier.values() if len(rows) > 1]
        met = np.array(met, np.float32).T if met else np.zeros((n, 0), np.float32)
        links = np.zeros(n, np.int64)
        label = ids.copy()
        # In a pair of two blocks only pairs across are compared; each block has a cell of its own.
        own = np.asarray(leaf.column("own"))
        across = leaf.column("i")[0].as_py() != leaf.column("j")[0].as_py()
        near = np.zeros((n, n), bool)
        for a in range(0, n, _BLOCK):
            rows = slice(a, a + _BLOCK)
            close = x[rows] @ x.T >= cosine
            close[np.arange(len(close)), np.arange(a, a + len(close))] = False
            if across:
                close &= own[rows, None] != own
            near[rows] = close
            links[rows] = (close & (met[rows] @ met.T == 0)) @ times
        while True:
            least = np.array([label[row].min(initial=label[i]) for i, row in enumerate(near)], np.int64)
            least = np.minimum(least, label)
            if (least == label).all():
                break
            label = least
        return pa.table({"id": ids, "links": links, "component": label})

    return run


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """A row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label and length are linked if their cosine is at least ``cosine``; ``component_id`` is the smallest
    id that links reach. A null label, and a vector that is null, empty, zero or holds null or non-finite parts, link
    with nothing. Repeated rows are vectors of their own and link with each other. A null id takes no part: no links,
    null component, kept. An empty table gives an empty one.
    """
    v = F.col("v")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fine = F.coalesce(~F.exists(v, bad) & F.exists(v, lambda c: c != 0), F.lit(False)) & F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.withColumn("fine", fine)
    shape = {"grp": F.xxhash64("label", F.size("v")), "d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(1), F.reverse("v"))}
    sound = rows.filter("fine").withColumns(shape)
    key = ["grp", "d1", "d2"]
    classes = cut_lineage(sound.groupBy(*key, "v").agg(F.min("id").alias("id"), F.count("*").alias("times")))

    placed = cut_lineage(leaves(classes.select("grp", "id", "v"), trees, leaf_rows, cosine))
    homes = placed.groupBy("id").agg(F.collect_list(F.struct("tree", "node")).alias("homes"))
    full = placed.join(homes.join(classes.select("id", "times"), "id"), "id")
    compared = cells(full.select("grp", "tree", "node", "id", "v", "times", "homes", "blocks"))
    compared = cut_lineage(compared.applyInArrow(_compare(cosine), "id long, links long, component long"))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    edges = compared.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    parts = least_reachable(edges)
    classes = classes.join(links, "id", "left").join(parts, "id", "left")
    classes = classes.select(*key, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    found = sound.select("id", *key).join(classes, key).select("id", "links", "component")
    alone = rows.filter("not fine").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = found.union(alone)
    return out.select(
        F.col("id").alias("vec_id"),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op8_projection_forest(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
