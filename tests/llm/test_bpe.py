import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_odd import ODD

from barlens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(PATH, P.PATTERN)


def test_random_texts(coder, reference):
    rnd = random.Random(7)
    alphabet = "aabcdeE xyz  \n\t'sé ßñ中文😀0123!?.,  İſ"
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        ids = coder.encode(t)
        assert ids == reference.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_very_long_pieces(coder, reference):
    rnd = random.Random(8)
    for t in ("a" * 5000, "ab" * 5000, "".join(rnd.choice("abcdefghij") for _ in range(20_000)), " " * 3000, "é" * 4000):
        assert coder.encode(t) == reference.encode_ordinary(t)


def test_every_character_class(coder, reference):
    for c in range(0, 0x110000, 61):
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}b {chr(c)}1{chr(c)} "
            assert coder.encode(t) == reference.encode_ordinary(t)


def test_cache_generations(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    small = bpe.BytePairs(PATH, P.PATTERN)
    t = "one two three four one two five six one"
    assert small.encode(t) == reference.encode_ordinary(t)


def test_queue_is_empty_between_pieces(coder, reference):
    for t in ("unfathomable", "x" * 999, "ñandú" * 50):
        assert coder.merge(t.encode()) == reference.encode_ordinary(t)
        assert not coder.queue.buckets and not any(coder.queue.leaves)


def test_table(spark, odd, none, reference):
    got = bpe.digests(odd, PATH, P.PATTERN).collect()
    expected = []
    for i, t in ODD:
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe.digests(none, PATH, P.PATTERN).isEmpty()


def test_encode_and_decode_apart(odd):
    encoded = bpe.encode(odd, PATH, P.PATTERN)
    back = bpe.decode(encoded, PATH, P.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=repr) == sorted(((i, (t or "").encode()) for i, t in ODD), key=repr)
