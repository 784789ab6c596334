"""How far the sources of a language differ in their words, by run-length columns.

Every language keeps the terms that enough of its documents hold. A group (language and source) is a column of counts over
these terms, and a count gives the term's smoothed share p. Two groups differ by the sum of floor((p - q)^2 / (p + q)).

1. one pass over the texts counts terms and the documents they are in, combined in the task by group;
2. per language the terms are reordered by their row of counts, smallest group first, so that equal counts stand together;
   a range shuffle by (language, counts, term) gives blocks of terms, so neither a language nor a row of counts that many
   terms share meets in one task;
3. in a block each column is run-length encoded. For a pair of groups the run boundaries are merged and f of each stretch
   is multiplied by its length: work goes with the runs, not with the terms;
4. the blocks' sums are added up. All arithmetic is on whole numbers.

A block is one task's group: BLOCK_TERMS terms at most, beside one row per group of its language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import binaries, matches, table

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms of a block as a power of two, and counts a task holds before it hands them on.
BLOCK_BITS, HELD = 15, 250_000
#: Groups that are broadcast at most; beyond that counts meet them in a shuffled join.
BROADCAST_GROUPS = 100_000
# A-Z are lowered first; all bytes beyond ASCII belong to terms.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _count(batches):
    """Occurrences and documents of each term by group; a null term stands for the group itself."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    held, seen = defaultdict(Counter), defaultdict(Counter)

    def out():
        for (lang, source), counts in held.items():
            terms = list(counts)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64()), pa.array([seen[lang, source][t] for t in terms], pa.int64())], schema=kind)

    groups, size = set(), 0
    for batch in batches:
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2))):
            groups.add((lang, source))
            counts, before, own = held[lang, source], len(held[lang, source]), set()
            for found in matches(_TERM, raw.lower()):
                counts.update(found)
                own.update(found)
            seen[lang, source].update(own)
            size += len(counts) - before
            if size >= HELD:
                yield from out()
                held.clear(), seen.clear()
                size = 0
        if len(groups) >= HELD:
            yield _only_groups(groups, kind)
            groups = set()
    yield from out()
    yield _only_groups(groups, kind)


def _only_groups(groups, kind):
    rows = [{"lang": a, "source": b, "term": None, "n": 0, "docs": 0} for a, b in groups]
    return pa.RecordBatch.from_pylist(rows, schema=kind)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term; one null term per group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _small(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10)) * CAST({n} + 2 AS DECIMAL(19))) DIV CAST({total} + 2 * {terms} AS DECIMAL(19))")


def distance(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``share`` of an array of counts."""
    if not len(counts) or int(counts.max()) + 2 < (1 << 62) // SCALE:
        return 1 + SCALE * (counts + 2) // (total + 2 * terms)
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * terms) for c in counts], np.int64)


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code of a column: where runs start, and their values."""
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    return starts, column[starts]


def meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of floor((p - q)^2 / (p + q)) over two run-length columns of shares."""
    cuts = np.union1d(a[0], b[0])
    p, q = (c[1][np.searchsorted(c[0], cuts, "right") - 1] for c in (a, b))
    return int(((p - q) ** 2 // (p + q) * np.diff(np.r_[cuts, length])).sum())


def _block(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """A block's part of each pair's sum."""
    rows = rows.sort_by("place")
    length, vectors = rows.num_rows, rows.column("vector").combine_chunks()
    term = np.repeat(np.arange(length), np.diff(vectors.offsets.to_numpy()))
    entries = vectors.flatten()
    at, n = entries.field("at").to_numpy(), entries.field("n").to_numpy()
    by_group = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[by_group], np.arange(groups.num_rows + 1))
    groups = groups.sort_by("at")
    coded = []
    for g, (total, terms) in enumerate(zip(groups.column("total").to_pylist(), groups.column("terms").to_pylist())):
        own, column = by_group[bounds[g] : bounds[g + 1]], np.zeros(length, np.int64)
        column[term[own]] = n[own]
        starts, counts = runs(column)
        coded.append((starts, _shares(counts, total, terms)))
    names, lang = groups.column("source").to_pylist(), groups.column("lang")[0].as_py()
    sums = [(names[i], names[j], meet(coded[i], coded[j], length)) for i in range(len(names)) for j in range(i)]
    a, b, f = zip(*sums) if sums else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "f": pa.array(f, pa.int64())})


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: a row for each other source of the language, with their distance. Part ``term``: the ``top`` kept terms
    that the group uses more than its language does, with the term's distance. Ranks go by value, then by item.

    Null texts, languages and sources count as empty ones. A text without terms still makes its group occur. Repeated rows
    are documents of their own. A language that keeps no term has distances of 0 and no terms; one with a single source
    has no pairs; an empty table gives an empty one. Other columns are not looked at.
    """
    found = cut_lineage(counted(docs, text, lang, source))
    term = Window.partitionBy("lang", "term")
    # A partition of this window has one row per group of the language.
    kept = found.filter("term is not null").withColumns(
        {"all_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1}
    )
    kept = cut_lineage(kept.filter(F.col("all_docs") >= least_docs).drop("docs", "all_docs"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("terms"))
    groups = found.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("lang_terms"))
    # Small groups first: their columns have few different counts, so runs stay long for the columns behind them.
    at = F.row_number().over(Window.partitionBy("lang").orderBy("total", "source")) - 1
    groups = cut_lineage(groups.drop("terms").join(whole, "lang").withColumn("at", at).withColumnRenamed("lang_terms", "terms"))
    kept = kept.join(_small(groups), ["lang", "source"])

    vectors = kept.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("vector"))
    order = ["lang", "vector", "term"]
    placed = vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    blocks = cut_lineage(placed.select("lang", F.shiftright("place", BLOCK_BITS).alias("block"), "place", "vector"))
    each = blocks.select(F.col("lang").alias("of"), F.col("block").alias("nr")).distinct()
    beside = each.join(groups, F.col("lang") == F.col("of"))
    parts = blocks.groupBy("lang", "block").cogroup(beside.groupBy("of", "nr")).applyInArrow(_block, "lang string, a string, b string, f long")
    half = parts.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    names = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    bare = groups.filter("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = half.select("lang", names, "value").unionByName(none).withColumn("rank", F.row_number().over(ranks))

    shares = kept.withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}).filter("p > q")
    terms = shares.select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)
    name = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return name(pairs, "pair").unionByName(name(terms, "term"))


def op13_divergence_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_n FROM x GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN v USING (lang, term) GROUP BY ALL),
z AS (SELECT lang, count(*)::HUGEINT AS terms, sum(lang_n)::HUGEINT AS total FROM v GROUP BY 1), t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(t.total, 0) + 2 * z.terms) AS p,
  1 + 1000000000::HUGEINT * (lang_n + 2) // (z.total + 2 * z.terms) AS q
  FROM g JOIN v USING (lang) JOIN z USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
