"""Token counts and trie encoding against the tokenizers library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import bpe_trie, token_counts

from .conftest import ODD


def strange(n, seed):
    rng = random.Random(seed)
    pools = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x3000), lambda: rng.randrange(0x110000), lambda: rng.choice([32, 10, 9, 0x1C, 0x85, 0x3A3, 0x301, 0x130])]
    for _ in range(n):
        text = "".join(chr(rng.choice(pools)()) for _ in range(rng.randrange(50)))
        yield text.encode("utf-8", "ignore").decode()


@pytest.fixture(scope="module")
def texts(real):
    return [t for t in ODD if t is not None] + list(real[1].values())[:80] + list(strange(1500, 5))


def test_counts_equal_the_library(texts):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.PieceCounter(path).count(texts) == expected
    # A counter that forgets all the time gives the same.
    small = token_counts.PieceCounter(path, remembered=3)
    assert [small.count([t])[0] for t in texts] == expected


def test_encoding_and_decoding_equal_the_library(texts):
    path = public_tokenizers.path(bpe_trie.VOCABULARY)
    library = Tokenizer.from_file(path)
    encoder = bpe_trie.Encoder(path, remembered=200)
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        for t, (ids, decoded), e in zip(part, encoder.encode(part), library.encode_batch(part, add_special_tokens=False)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == e.ids, t[:80]
            assert decoded == library.decode(e.ids, skip_special_tokens=False) == encoder.decode(e.ids)


def test_every_code_point_is_normalised_and_split_alike():
    bpe = bpe_trie.WordBpe(public_tokenizers.path(bpe_trie.VOCABULARY))
    for cp in [c for c in range(0x250) if c not in (0x130,)]:
        text = f"a{chr(cp)}{chr(cp)}b"
        normalizer, splitter = bpe.rules
        spelt = splitter.pre_tokenize_str(normalizer.normalize_str(text))
        assert list(map(bpe.spell, bpe.words(text))) == [w for w, _ in spelt if w], hex(cp)


def test_prefixes_are_shared():
    """Sorted words that share a prefix give what each gives alone."""
    bpe = bpe_trie.WordBpe(public_tokenizers.path(bpe_trie.VOCABULARY))
    words = sorted({"in", "inter", "international", "internationally", "internet", "a", "aa", "aaa", "aaaa" * 50, "zzzz"})
    alone = [next(bpe.encode_sorted([w])) for w in words]
    assert list(bpe.encode_sorted(words)) == alone


def test_frames(odd_docs, no_docs):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    out = token_counts.token_counts(odd_docs.withColumnRenamed("lang", "n_bytes"), path).collect()
    assert len(out) == 2 * len(ODD) + 1
    assert {r.doc_id: r.n_tokens for r in out}[0] == 0 and {r.doc_id: r.n_tokens for r in out}[1] == 0
    assert token_counts.token_counts(no_docs, path).count() == 0

    path = public_tokenizers.path(bpe_trie.VOCABULARY)
    clash = odd_docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    out = {r.doc_id: r for r in bpe_trie.encode(clash, path).collect() if r.doc_id is not None}
    library = Tokenizer.from_file(path)
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].decoded == library.decode(ids, skip_special_tokens=False)
    digests = {r.doc_id: r for r in bpe_trie.encode(odd_docs, path, keep=["doc_id"], digests=True).collect()}
    assert digests[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe_trie.encode(no_docs, path).count() == 0
