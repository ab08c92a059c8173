import hashlib
import random
import re

import pytest
from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows, texts

from postlytics.llm import registry, secret_scan as S

XPRV = ("xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi")


def brute(text):
    tests = (lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16)
    out = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(zip((S.ASSIGN, S.ACCESS, S.HEX), tests))
           for m in re.finditer(p, text) if ok(m)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def base(text):
    return [s for s in S.find_secrets(text) if s[0] < 3]


def test_random_texts_equal_plain_search():
    rng = random.Random(5)
    parts = ["password", "passwd", "secret", "token", "toKen", "ſecret", "api_key", "APIKEY", "toKen", "=", ":", " ", '"', "'",
             "AKIA", "ABCD1234", "abcdef0123", "dead", "beef", "G", "-", "İ", "\n", "é", "AKIAAKIA"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert base(text) == brute(text), text


def test_checksums_decide():
    body = "0Z12X34Y56W78V9U0tsrqpABCDEFGH"
    good, bad = "ghp_" + body + S.crc62(body), "ghp_" + body + "000000"
    assert [s[0] for s in S.find_secrets(f"x {good} y")] == [3]
    assert S.find_secrets(f"x {bad} y") == []
    assert [s[0] for s in S.find_secrets("npm_" + body + S.crc62(body))] == [4]
    assert (5, 2, 2 + len(XPRV)) in S.find_secrets("k " + XPRV)
    assert not any(s[0] == 5 for s in S.find_secrets("k " + XPRV[:-1] + ("j" if XPRV[-1] != "j" else "k")))


def test_failing_match_uses_up_its_text():
    assert base("password: secret: abcdefghijklmnop") == brute("password: secret: abcdefghijklmnop") == []
    assert [s[0] for s in base("token=abcdefghijkl")] == [0]


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in registry.op1_secret_scan(spark, SF_SMALL).collect()}
    for doc, text in texts(spark, SF_SMALL).items():
        spans = brute(text)
        r = got[doc]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in range(3)]
        joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert len(got) == len(texts(spark, SF_SMALL))


def test_awkward_rows(spark):
    rows = awkward(spark)
    assert S.scan(rows).count() == rows.count()
    assert same_rows(S.scan(rows), S.scan(clashing(rows)))
    assert S.scan(empty(spark)).count() == 0


def test_redaction_blanks_only_secrets(spark):
    df = spark.createDataFrame([(1, "my password=abcdefghijklmnop ok", 31), (2, "clean", 5), (3, None, None)],
                               "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in S.redact(df).collect()}
    assert got[1]["text"] == "my [secret] ok" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[3]["n_chars"] is None
    assert S.redact(df).schema == df.schema


@pytest.mark.parametrize("text", ["", "x", "AKIA" + "A" * 14, "0" * 15, "f" * 16])
def test_borders(text):
    assert base(text) == brute(text)
