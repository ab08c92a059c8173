import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows, texts

from postlytics.llm import bpe, registry

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


def test_random_texts(codec, library):
    rng = random.Random(1)
    parts = [*"abcdefghijklmnopqrstuvwxyzABC 0123'.,!?\n\t éüßñ日本語中文кирилл", " ", "\x1c", "\x85", "\xa0", "²", "½", "Ⅷ",
             "👍", "‍", "__", "'s", "'ll", "  "]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert codec.ids(text).tolist() == library.encode_ordinary(text), text
        assert codec.decode(codec.ids(text), chunk=3) == text


def test_letters_of_every_script(codec, library):
    for start in range(0, 0x30000, 7):
        if not 0xD800 <= start < 0xE000:
            text = "a" + chr(start) + " b"
            assert codec.ids(text).tolist() == library.encode_ordinary(text), hex(start)


def test_emptied_tables_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 40)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 10)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    small = bpe.Codec(PATH, P.PATTERN)
    rng = random.Random(2)
    for _ in range(100):
        text = " ".join("".join(rng.choices("abcdeiostn", k=rng.randint(1, 60))) for _ in range(5))
        assert small.ids(text).tolist() == library.encode_ordinary(text)


def test_streaming_decode_of_broken_bytes(codec):
    rng = random.Random(3)
    one = {codec.tokens[i]: i for i in range(len(codec.tokens)) if len(codec.tokens[i]) == 1}
    for _ in range(2000):
        raw = bytes(rng.choices([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xF4, 0x90, 0xC0, 0xFF], k=rng.randint(1, 12)))
        ids = np.array([one[bytes([b])] for b in raw], np.uint32)
        assert codec.decode(ids, chunk=rng.randint(1, 4)) == raw.decode("utf-8", "replace")


def test_query_equals_library(spark, library):
    got = {r["doc_id"]: r for r in registry.op5_byte_bpe(spark, SF_SMALL).collect()}
    for doc, text in texts(spark, SF_SMALL).items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        r = got[doc]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(spark):
    rows = awkward(spark)
    got = bpe.encode(rows, PATH, P.PATTERN)
    assert got.count() == rows.count()
    assert got.where("doc_id = 2").first()["n_tokens"] == 0 and got.where("doc_id = 2").first()["ids"] == []
    assert same_rows(got, bpe.encode(clashing(rows), PATH, P.PATTERN))
    assert bpe.encode(empty(spark), PATH, P.PATTERN).count() == 0
