"""BPE encoding of distinct words over an implicit trie, and decoding.

For a fixed list of merges the encoding of a prefix is fixed by its last token: the encoding of ``w[:d]`` ends in token t
exactly if t spells ``w[d-len(t):d]`` and may follow the last token of ``w[:d-len(t)]`` (the two would not have been
merged differently across their border). Words in sorted order are the depth-first order of their trie: the states of
the prefix a word shares with the one before are on the stack already, and only the rest is computed. The last
character of a word carries the end mark and is a symbol of its own, so it is the leaf's state.

Scale: a scan and a narrow map, no shuffle. A task remembers words up to a bound; batches are cut by bytes.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, text_last
from .token_counts import _by_bytes

VOCABULARY = "word_bpe_49k.json"
BATCH_BYTES = 1 << 20
REMEMBERED = 120_000
REMEMBERED_CHARS = 64

# White space as the vocabulary's splitting pattern has it; \x1c-\x1f are none.
_CHUNKS = re.compile(r"[\S\x1c-\x1f]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class WordBpe:
    """The vocabulary: merges, the inverse of each merge, and what may follow what."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.ids | self.specials).items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in merges}
        self.halves = {c: pair for pair, c in self.rank.items()}
        bodies = [s.removesuffix(self.end) for s in self.ids]
        self.starts = {s[:k] for s in bodies for k in range(1, len(s) + 1)}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.inner: dict[str, tuple] = {}  # by the longest token start that ends here: tokens that end here
        self.final: dict[str, tuple] = {}  # the same for tokens with the end mark
        self.pairs: dict[int, bool] = {}
        self.path = path

    @functools.cached_property
    def rules(self) -> tuple:
        """The vocabulary's own normaliser and splitter; loaded when a text needs them."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        return whole.normalizer, whole.pre_tokenizer

    def follows(self, left: int, right: int) -> bool:
        """True if encoding the two tokens' joined spelling gives just these two tokens.

        Undoes merges next to the border from the latest to the earliest; ids grow with the rank of merges. A merge
        across the border that comes before what has been undone would have taken place instead.
        """
        undone = 1 << 60
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined < undone:
                return False
            by_left, by_right = left in self.halves, right in self.halves
            if not by_left and not by_right:
                return True
            # Of equal ranks the leftmost merge comes first, so a right half of the same id is undone first.
            if by_left and (not by_right or left > right):
                undone, left = left, self.halves[left][1]
            else:
                undone, right = right + 1, self.halves[right][0]

    def _ending(self, text: str, mark: str) -> tuple:
        """Length and id of the tokens that end ``text``, the longest first."""
        found = ((k, self.ids.get(text[-k:] + mark)) for k in range(len(text), 0, -1))
        return tuple((k, t) for k, t in found if t is not None)

    def encode_sorted(self, spellings: list[str]):
        """Yields the token ids of each word of a sorted list of distinct byte-letter spellings."""
        starts, inner, final, pairs, follows = self.starts, self.inner, self.final, self.pairs, self.follows
        if len(final) > 200_000 or len(pairs) > 500_000:
            final.clear()
            pairs.clear()
        last: list[int] = []  # of the prefix of length d+1: its last token
        size: list[int] = []  # and that token's length
        reach: list[int] = []  # and the length of the longest token start that it ends in
        before = ""
        for word in spellings:
            n = len(word)
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            # The last letter is a symbol of its own and has no inner state.
            shared = min(shared, n - 1, len(last))
            del last[shared:], size[shared:], reach[shared:]
            k = reach[-1] if shared else 0
            for d in range(shared + 1, n):
                k += 1
                while (tail := word[d - k : d]) not in starts:
                    k -= 1
                reach.append(k)
                here = inner.get(tail)
                if here is None:
                    here = inner[tail] = self._ending(tail, "")
                for length, t in here:
                    if length == d:
                        break
                    left = last[d - length - 1]
                    fits = pairs.get(left << 17 | t)
                    if fits is None:
                        fits = pairs[left << 17 | t] = follows(left, t)
                    if fits:
                        break
                last.append(t)
                size.append(length)
            tail = word[n - 1 - k :]
            here = final.get(tail)
            if here is None:
                here = final[tail] = self._ending(tail, self.end)
            for length, t in here:
                if length == n:
                    break
                left = last[n - length - 1]
                fits = pairs.get(left << 17 | t)
                if fits is None:
                    fits = pairs[left << 17 | t] = follows(left, t)
                if fits:
                    break
            out, d = [t], n - length
            while d:
                out.append(last[d - 1])
                d -= size[d - 1]
            out.reverse()
            yield out
            before = word

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens.

        Text that stays below U+0250 when lowered has its normal form already and is split by rule; for all other the
        vocabulary's own normaliser and splitter decide.
        """
        low = text.lower()
        if text.isascii():
            return _ASCII.findall(low)
        if max(low) < "\u0250":
            return _LATIN.findall(low)
        out: list[str] = []
        for chunk in _CHUNKS.findall(text):
            low = chunk.lower()
            if max(low) < "\u0250":
                out += _LATIN.findall(low)
            else:
                normalizer, splitter = self.rules
                spelt = splitter.pre_tokenize_str(normalizer.normalize_str(chunk))
                out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in spelt if w]
        return out

    def spell(self, word: str) -> str:
        """The word in byte letters."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))


def _splitter(letters: str, numbers: str) -> re.Pattern:
    gaps = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{gaps}{letters}{numbers}]+")


_LATIN = _splitter(
    "".join(c for c in map(chr, range(0x250)) if c.isalpha()),
    "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N"),
)
_ASCII = _splitter("a-zA-Z", "0-9")


class Encoder:
    """Whole texts, by words that a task has met before or encodes now."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.bpe = WordBpe(path)
        self.remembered = remembered
        self.known: dict[str, tuple[bytes, str]] = {}  # ids as little-endian bytes and the decoded word

    def _learn(self, new: set[str]) -> None:
        bpe, known, names, pack = self.bpe, self.known, self.bpe.names.__getitem__, _IDS
        spelt = sorted((bpe.spell(w), w) for w in new)
        for (_, word), ids in zip(spelt, bpe.encode_sorted([s for s, _ in spelt])):
            packed = pack[len(ids)](*ids) if len(ids) < len(pack) else struct.pack(f"<{len(ids)}I", *ids)
            known[word] = (packed, " ".join(map(names, ids)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as bytes and decoded text (tokens joined by a space, as the vocabulary has no decoder)."""
        special, split = self.bpe.special, self.bpe.words
        cut = []
        for t in texts:
            parts = special.split(t) if "<|" in t else [t]
            cut.append([split(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        plain = [part for parts in cut for part in parts[::2]]
        new = set().union(*plain).difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            # Keep what these texts need; a frequent word is in all of them.
            self.known = {w: self.known[w] for w in set().union(*plain).difference(new)}
        self._learn(new)
        known, out = self.known.__getitem__, []
        for parts in cut:
            found = []
            for i, part in enumerate(parts):
                found += map(known, part) if i % 2 == 0 else [(struct.pack("<I", self.bpe.specials[part]), part)]
            ids, decoded = zip(*found) if found else ((), ())
            out.append((b"".join(ids), " ".join(decoded)))
        for w in [w for w in new if len(w) > REMEMBERED_CHARS]:
            del self.known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.bpe.names.__getitem__, ids))


#: Packers of the usual numbers of ids.
_IDS = [struct.Struct(f"<{n}I").pack for n in range(12)]


@functools.lru_cache(maxsize=1)
def _shared(path: str) -> Encoder:
    """The vocabulary is loaded once per Python worker, which runs many tasks."""
    return Encoder(path)


def _encoder(path: str, digests: bool):
    def encoded(encoder, batch):
        *rest, text = [batch.column(i) for i in range(batch.num_columns)]
        names = batch.schema.names[:-1]
        for start, texts in _runs(text):
            found = encoder.encode(texts)
            kept = [c.slice(start, len(texts)) for c in rest]
            n = pa.array([len(b) // 4 for b, _ in found], pa.int64())
            if digests:
                a = pa.array([hashlib.sha256(b).hexdigest() for b, _ in found])
                b = pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in found])
                new, labels = [n, a, b], ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                ids = pa.array([memoryview(b).cast("I").tolist() for b, _ in found], pa.list_(pa.int32()))
                new, labels = [n, ids, pa.array([s for _, s in found], pa.string())], ["n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names, *labels])

    def run(batches):
        encoder = _shared(path)
        gc.disable()  # nothing here makes cycles, and collections would walk all remembered words
        try:
            for batch in batches:
                yield from encoded(encoder, batch)
        finally:
            # The worker lives on for other stages.
            encoder.known = {}
            gc.enable()

    return run


def _runs(text):
    start = 0
    for texts in _by_bytes((t.as_py() or "" for t in text), BATCH_BYTES):
        yield start, texts
        start += len(texts)


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``keep`` columns (default: all but the text), ``n_tokens``, and ``ids`` with ``decoded`` or their digests.

    Null and empty texts give no ids and an empty decoded text. Columns named like the new ones are replaced.
    """
    made = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in made]
    kinds = ["long", "string", "string"] if digests else ["long", "array<int>", "string"]
    picked, schema = text_last(docs, keep, text, dict(zip(made, kinds)))
    return picked.mapInArrow(_encoder(path, digests), schema)


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep=["doc_id"], digests=True)
