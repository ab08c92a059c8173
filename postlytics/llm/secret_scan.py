"""Secret scan: one Aho-Corasick pass finds keywords, anchored expressions run only at hits.

The automaton walks the lower-cased text once.  Each hit names a kind and a
start; the kind's expression is matched *at* that start (never searched), a
start inside the kind's previous match is passed over, so the spans are the
leftmost non-overlapping ones.  Kinds whose format embeds a checksum are kept
only if it holds.

Base kinds: ``assign``, ``access``, ``hex``.  Added kinds: ``github`` and
``npm`` tokens (CRC-32 in base 62 over the 30 random characters) and ``xprv``
extended private keys (base 58 with a double SHA-256 check).
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import documents, kept, map_batches, ship, slices, trimmed

# Fixed values (the public formats of these secrets).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE_KINDS = KINDS[:3]


def crc62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _crc_token(m: re.Match) -> bool:
    token = m[0][4:]
    return crc62(token[:30]) == token[30:]


def base58_check(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: kind -> (expression, test of a match); a match that fails is dropped but still uses up its text.
RULES = (
    (ASSIGN, lambda m: m.end(2) - m.start(2) >= 12),
    (ACCESS, lambda m: m.end() - m.start() >= 18),
    (HEX, lambda m: m.end() - m.start() >= 16),
    (GITHUB, _crc_token),
    (NPM, _crc_token),
    (XPRV, lambda m: base58_check(m[0])),
)

_AUTOMATON = kept("secrets")


def _automaton():
    """Keywords with (length, kind). Four hex digits in a row start or continue every run of 16."""
    if "all" not in _AUTOMATON:
        a = ahocorasick.Automaton()
        for gram in itertools.product("0123456789abcdef", repeat=4):
            a.add_word("".join(gram), (4, 2))
        words = {0: ("password", "passwd", "secret", "token", "apikey", "api_key"), 1: ("akia",),
                 3: ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 4: ("npm_",), 5: ("xprv",)}
        for kind, keys in words.items():
            for k in keys:
                a.add_word(k, (len(k), kind))
        a.make_automaton()
        _AUTOMATON["all"] = a
    return _AUTOMATON["all"]


_UPPER = {c: c + 32 for c in range(65, 91)}


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    low = text.lower()
    if len(low) != len(text):  # a letter that lower-cases to more than one
        low = text.translate(_UPPER)
    used = [0] * len(KINDS)
    found = []
    for last, (size, kind) in _automaton().iter(low):
        start = last + 1 - size
        if start < used[kind]:
            continue
        rule, holds = RULES[kind]
        m = rule.match(text, start)
        if m:
            used[kind] = m.end()
            if holds(m):
                found.append((kind, start, m.end()))
    if len(found) > 1:
        found.sort(key=lambda s: (s[1], s[0]))
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every row once, spans by start, then kind as listed in ``KINDS``.

    A null or empty text has no spans; repeated rows give repeated rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find_secrets(t)]
                 for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "spans": spans}

    return map_batches(documents(docs, id_col, text_col), f"doc_id long, spans {SPANS}", run, keep="secrets")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact_text(text: str) -> str:
    """Each secret becomes ``[secret]``; overlapping spans become one."""
    out, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets blanked; the length column, if there, follows the text.

    Clean and null texts are untouched, and so is their length.
    """
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    at = names.index(text_col)
    n_at = names.index(length_col) if length_col in names else None
    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1000)):
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [None if t is None else redact_text(t) for t in old]
            cols[at] = pa.array(new, type=arrow.field(at).type)
            if n_at is not None:
                sizes = [n if a is None or a == b else len(b) for n, a, b in zip(cols[n_at].to_pylist(), old, new)]
                cols[n_at] = pa.array(sizes, type=arrow.field(n_at).type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.mapInArrow(trimmed(run, keep="secrets"), docs.schema)
