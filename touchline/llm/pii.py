"""Personal data: fixed patterns, and terms that give the protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Around each lie a few context terms. The corpus
tells how much a term t discloses an entity kind c: with document frequencies, PMI(t; c) / IC(c), where IC(c) = -log p(c)
is what there is to hide. The ratio is 1 if t occurs with c alone and 0 if it says nothing. Terms seen with enough
different entities are generalised from one threshold on and removed from a higher one. A repeated copy of one text adds
no entity, so copies cannot make a term suspicious.

The context only tells which terms disclose; a disclosing term is then found wherever it stands in any text, with or
without an entity beside it, and gets the strictest of its actions.

Everything on the rows is DataFrame functions. The base pass reads each text once into a narrow checkpointed table;
document frequencies are one map-side combined count over all words of all texts. Context rows are few; they meet the
frequencies in a join on the term, of which each side has one row. A last pass places all terms of all texts and keeps
the disclosing ones by a join on the term, broadcast if they are few enough; texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import let, table

# The patterns. Possessive quantifiers and the look-behind keep them linear in the text; \G lets a match
# begin where the one before ended.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
#: What a text must hold for its pattern to be tried.
GUARDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP = rf"\A{_PART}(?:\.{_PART}){{3}}\z"

GENERALISE, REMOVE = 0.6, 0.9
#: Different entities a term must have been met with.
SUPPORT = 5
#: A span's context: this many terms on each side, within so many code points.
CONTEXT_TERMS, CONTEXT_CHARS = 4, 80
#: Disclosing terms that are broadcast at most.
BROADCAST_TERMS = 1_000_000
TERM = r"""[^\x20\x09-\x0D.,;:!?"()]+"""
TERM_GAP = r"""[\x20\x09-\x0D.,;:!?"()]+"""
_BLOCK = 64


def _running(lengths: Column) -> Column:
    """For each element the sum of those before it; block sums keep it from being quadratic."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def with_blocks(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(n, b * _BLOCK + 1, _BLOCK)))
        starts = F.aggregate(
            sums,
            F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("sum")),
            lambda a, s: F.struct(F.concat(a["at"], F.array(a["sum"])).alias("at"), (a["sum"] + s).alias("sum")),
            lambda a: a["at"],
        )
        return let(
            starts,
            lambda at: F.transform(
                n, lambda _, i: F.get(at, F.floor(i / _BLOCK).cast("int")) + total(F.slice(n, i - i % _BLOCK + 1, i % _BLOCK))
            ),
        )

    return let(lengths, with_blocks)


def matches(text: Column, pattern: str) -> Column:
    """Matches as ``array<struct<start, end, value>>`` in code points; the pattern matches no empty string.

    Pieces between matches come from a split by the same pattern, and positions are running sums of both lengths.
    """
    kind = "array<struct<start:int,end:int,value:string>>"

    def place(found: Column) -> Column:
        values, gaps = found["values"], found["gaps"]
        lengths = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))
        starts = let(
            _running(lengths),
            lambda before: F.transform(
                values,
                lambda v, i: let(
                    F.get(before, i) + F.length(F.get(gaps, i)),
                    lambda at: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value")),
                ),
            ),
        )
        return F.when(F.size(values) > 0, starts)

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")
    )
    return F.coalesce(let(both, place), F.array().cast(kind))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(IP)
    low, high = (16, 19) if kind == "card" else (8, 15)
    digits = F.regexp_replace(value, "[^0-9]+", "")
    fits = F.length(digits).between(low, high)
    return fits & let(digits, _luhn) if kind == "card" else fits


def base_spans(text: Column) -> Column:
    """``array<struct<kind, start, end, value>>``, by kind as listed and then by start; null texts have none."""

    def of(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        named = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(text.rlike(GUARDS[kind]), named).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))

    return F.concat(*[of(k) for k in KINDS])


def _context(text: Column, spans: Column) -> Column:
    """``array<struct<kind, entity, term, start, end>>``: terms beside each span that touch no span.

    A term cut off by the edge of the window is left out.
    """

    def around(s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - CONTEXT_CHARS)
        before = let(F.substr(text, low + 1, s["start"] - low), lambda w: matches(F.lower(w), TERM))
        before = F.filter(before, lambda m: (m["start"] > 0) | (low == 0))
        before = F.reverse(F.slice(F.reverse(before), 1, CONTEXT_TERMS))
        before = F.transform(before, lambda m: F.struct((m["start"] + low).alias("start"), (m["end"] + low).alias("end"), m["value"].alias("value")))
        after = let(F.substr(text, s["end"] + 1, F.lit(CONTEXT_CHARS)), lambda w: F.filter(matches(F.lower(w), TERM), lambda m: m["end"] < CONTEXT_CHARS))
        after = F.transform(F.slice(after, 1, CONTEXT_TERMS), lambda m: F.struct((m["start"] + s["end"]).alias("start"), (m["end"] + s["end"]).alias("end"), m["value"].alias("value")))
        return F.transform(
            F.concat(before, after),
            lambda m: F.struct(
                s["kind"].alias("kind"), F.xxhash64(s["value"]).alias("entity"), m["value"].alias("term"), m["start"].alias("start"), m["end"].alias("end")
            ),
        )

    near = F.flatten(F.transform(spans, around))
    return F.filter(near, lambda m: ~F.exists(spans, lambda s: (m["start"] < s["end"]) & (s["start"] < m["end"])))


def _digest(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.hash(F.reverse(text)).alias("b"), F.length(text).alias("n"))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow checkpointed table, a row per document: ``doc_id, digest, base, context``.

    ``digest`` names the text, so what follows from the text alone is worked out once for all its copies.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    picked = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_text"))
    spanned = picked.withColumn("base", base_spans(F.col("_text")))
    some = F.size("base") > 0
    none = F.array().cast("array<struct<kind:string,entity:bigint,term:string,start:int,end:int>>")
    return cut_lineage(
        spanned.select(
            "doc_id",
            _digest(F.col("_text")).alias("digest"),
            F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"),
            F.when(some, _context(F.col("_text"), F.col("base"))).otherwise(none).alias("context"),
        )
    )


def disclosures(docs: DataFrame, found: DataFrame, *, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """Terms over the threshold: ``kind, term, support, disclosure, action``. Counts go over all documents."""
    has = lambda k: F.sum(F.exists("base", lambda s: s["kind"] == k).cast("long")).alias(k)
    totals = found.agg(F.count("*").alias("n"), *map(has, KINDS)).first()
    n = totals["n"]
    hidden = {k: math.log(n / totals[k]) for k in KINDS if totals[k]}

    # One entity per document, kind and term.
    met = found.filter(F.size("context") > 0).select(F.explode("context").alias("c"), F.monotonically_increasing_id().alias("row"))
    met = met.groupBy("row", "c.kind", "c.term").agg(F.min("c.entity").alias("entity"))
    met = met.groupBy("kind", "term", "entity").count().groupBy("kind", "term").agg(F.sum("count").alias("together"), F.count("*").alias("support"))
    met = met.filter(F.col("support") >= support)

    terms = F.split(F.lower(F.col(text)), TERM_GAP, -1)
    frequency = docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").count()
    ic = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in hidden.items()]) if hidden else F.lit(None).cast("double")
    # PMI / IC = 1 - log(df / together) / log(n / n_kind)
    ratio = F.when(ic > 0, 1 - F.log(F.col("count") / F.col("together")) / ic)
    judged = met.join(frequency, "term").withColumn("disclosure", ratio).filter(F.col("disclosure") >= generalise)
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    return judged.select("kind", "term", "support", "disclosure", action.alias("action"))


def term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame, *, text: str = "text") -> DataFrame:
    """``digest, terms``: spans ``<kind, start, end>`` of disclosing terms in each text, kind ``generalise`` or ``remove``.

    Every place of a term counts that touches no base span.
    """
    judged = cut_lineage(terms.groupBy("term").agg(F.max("action").alias("kind")))
    if judged.count() <= BROADCAST_TERMS:
        judged = F.broadcast(judged)
    t = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(t.alias("_text")).select(_digest(F.col("_text")).alias("digest"), F.explode(matches(F.col("_text"), TERM)).alias("m"))
    placed = placed.select("digest", F.lower("m.value").alias("term"), "m.start", "m.end")
    hit = placed.join(judged, "term").groupBy("digest", "start", "end").agg(F.max("kind").alias("kind"))
    hit = hit.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("terms"))
    spans = found.filter(F.size("base") > 0).select("digest", "base").dropDuplicates(["digest"])
    free = F.filter("terms", lambda m: ~F.exists("base", lambda s: (m["start"] < s["end"]) & (s["start"] < m["end"])))
    return hit.join(spans, "digest", "left").select("digest", F.when(F.col("base").isNull(), F.col("terms")).otherwise(free).alias("terms"))


def detect(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document: ``doc_id, base, terms``, both arrays of ``<kind, start, end>`` in code points, end exclusive.

    Base spans of different kinds may overlap; terms overlap none. Null and empty texts have no spans. Repeated rows and
    copies get the same spans. An empty table gives an empty one.
    """
    found = find(docs, doc_id=doc_id, text=text)
    terms = term_spans(docs, found, disclosures(docs, found, text=text, **options), text=text).withColumnRenamed("digest", "_d")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    near = found.join(terms, F.col("digest") == F.col("_d"), "left")
    return near.select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with each base span replaced by its kind in angle brackets, terms by ``<TERM>`` or nothing.

    Of overlapping spans the first holds; one that begins inside it is swallowed.
    """
    label = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "<TERM>").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    spans = F.array_sort(F.transform(F.concat(base, terms), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))))
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        upto = F.greatest(a["at"], s["end"])
        added = F.array(F.substr(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.when(s["start"] >= a["at"], s["label"]).otherwise(""))
        return F.struct(F.concat(a["out"], added).alias("out"), upto.alias("at"))

    return F.aggregate(spans, begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))


def op1_disclosure_pii(spark, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base", F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed(every).alias("spans"))
