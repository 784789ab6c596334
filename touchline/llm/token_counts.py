"""Token counts: Arrow batches of pieces, encoded together, of which only lengths come back.

Texts are cut in front of white space that follows something else. The vocabulary's pre-tokeniser always ends a token
there and never looks behind, so the pieces' counts add up to the text's count; a special token's string holds no white
space and stays in one piece. Pieces that are equal are encoded once per task and remembered up to a bound.

Scale: a scan and a narrow map, no shuffle. Batches are filled by bytes, so a task's memory does not depend on how long
texts are (a single text is in memory as a whole, as in any Arrow column).
"""

from __future__ import annotations

import functools
import gc
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_last

#: Bytes of text whose pieces are encoded together.
BATCH_BYTES = 2 << 20
#: Pieces remembered by a task; beyond that it starts anew.
REMEMBERED = 250_000
#: Longer pieces are not remembered.
REMEMBERED_CHARS = 64
LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"

# Optional Unicode white space, then anything else; or white space at the end. \x1c-\x1f are no white space here.
_MARKS = ".,;:!?"
_PIECES = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


class PieceCounter:
    """Counts tokens of texts by the counts of their pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        cut = [_PIECES.findall(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            # Keep what these texts need; a frequent piece is in all of them.
            self.known = {p: self.known[p] for p in set().union(*cut).difference(new)}
        known = self.known
        # A token also ends between a letter and one of these marks, so " word," is " word" and ",".
        marked = []
        for piece in new:
            bare = piece.rstrip(_MARKS)
            if bare != piece and bare and bare[-1].isalpha() and bare[-1] < "\u0250":
                marked.append((piece, bare, piece[len(bare) :]))
        apart = {part for _, bare, marks in marked for part in (bare, marks)}
        order = list(new.difference(p for p, _, _ in marked).union(apart).difference(known))
        known.update(zip(order, map(len, self.tokenizer.encode_batch_fast(order, add_special_tokens=False))))
        known.update((piece, known[bare] + known[marks]) for piece, bare, marks in marked)
        out = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in (*new, *order):
            if len(piece) > REMEMBERED_CHARS:
                known.pop(piece, None)
        return out


def _by_bytes(texts, most: int):
    """Runs of texts of about ``most`` bytes."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


@functools.lru_cache(maxsize=1)
def _shared(path: str) -> PieceCounter:
    """The vocabulary is loaded once per Python worker, which runs many tasks."""
    return PieceCounter(path)


def _counter(path: str, batch_bytes: int):
    def run(batches):
        counter = _shared(path)
        gc.disable()  # nothing here makes cycles, and collections would walk all remembered pieces
        try:
            for batch in batches:
                *rest, text = [batch.column(i) for i in range(batch.num_columns)]
                counts: list[int] = []
                for texts in _by_bytes((t.as_py() or "" for t in text), batch_bytes):
                    counts += counter.count(texts)
                names = [*batch.schema.names[:-1], "n_tokens"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64())], names=names)
        finally:
            # The worker lives on for other stages.
            counter.known = {}
            gc.enable()

    return run


def token_counts(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, batch_bytes: int = BATCH_BYTES):
    """``keep`` columns (default: all but the text) and ``n_tokens``; null and empty texts have none.

    An existing column of that name is replaced. Rows stay as they are, repeated ones too; an empty table gives one.

    ``path`` names a file of a vocabulary whose pre-tokeniser is the byte-level one; every executor must find it there.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "n_tokens")]
    picked, schema = text_last(docs, keep, text, {"n_tokens": "long"})
    return picked.mapInArrow(_counter(path, batch_bytes), schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    picked = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = token_counts(picked, public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
