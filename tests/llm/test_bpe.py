"""BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palisade.llm.bpe import Bpe, bpe_digests, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return Bpe(PATH), library


def cases():
    rng = random.Random(5)
    out = ["", " ", "  \n\n ", "a", "aaaa" * 500, "the the  the", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext", "don't we'll I'M", "\x1c\x1d\x85\xa0  z", "日本語のテキスト 😀😀 é è", "0" * 3000, "\t\r\n\x0b\x0c x", "\x00\x01"]
    letters = "abcdefghij ettaoin  shrdlu\n.,'0123éß中😀 \x1f-_=#"
    out += ["".join(rng.choices(letters, k=rng.randrange(1, 400))) for _ in range(400)]
    out += ["".join(rng.choices("ab", k=rng.randrange(1, 200))) for _ in range(200)]
    return out


def test_same_as_library(both):
    bpe, library = both
    for text in cases():
        want = library.encode(text, add_special_tokens=False).ids
        assert list(bpe.encode(text)) == want, text
        assert bpe.decode(bpe.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_every_token_string(both):
    bpe, library = both
    texts = [t.decode() for t in bpe.token if t.decode("utf-8", "ignore").encode() == t]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(bpe.encode(text)) == e.ids, text


def test_dataframe(spark, both):
    _, library = both
    rows = [(1, "Hello there", 0), (2, None, 1), (3, "", 2), (3, "", 2), (None, "x" * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(docs, PATH).collect()}
    want = set()
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe_digests(docs.limit(0), PATH).count() == 0
    assert {r.doc_id: len(r.ids) for r in encode_documents(docs.filter("doc_id < 3"), PATH).collect()} == {1: 2, 2: 0}
