"""Byte-level BPE by a lazily determinised transducer; decoding by an incremental UTF-8 machine.

Encoding.  A rank file says in which order byte pairs merge.  Two neighbouring
tokens can stand side by side in an encoding iff, while both grow by their
merges, no merge across their border comes first; a token sequence is *the*
encoding of a piece iff all neighbours can.  That gives a nondeterministic
machine over bytes: it guesses the next token, reads it along the vocabulary
trie, and may emit it if it goes with the token before.  ``Transducer``
determinises it while reading: a state is the set of live guesses, each with
the output it still holds back; output common to all guesses is emitted.  A
guess lives no longer than the longest token, so output follows after a bounded
lookahead.  States and transitions are made when first met, kept in a table of
bounded size, and made anew when the table is emptied.

Decoding.  Ids become bytes; ``Utf8Stream`` runs the UTF-8 validity automaton
over whole tokens (its step for each token and state is tabulated), so text can
be given out at code point borders while ids still arrive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postlytics.llm.common import documents, kept, map_batches

ROOT = 0
#: Bounds of the tables a worker keeps; emptying them costs time, never changes a result.
MAX_TRANSITIONS, MAX_PIECES, MAX_PAIRS = 300_000, 600_000, 400_000


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class Transducer:
    """Lazily determinised encoder of single pieces for one vocabulary."""

    def __init__(self, tokens: list[bytes], transitions: int | None = None):
        self.tokens = tokens
        self.most = transitions or MAX_TRANSITIONS
        self.rank = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [True]  # does the node lead on?
        for t, r in self.rank.items():
            node = ROOT
            for b in t:
                nxt = self.trie.get(node << 8 | b)
                if nxt is None:
                    nxt = self.trie[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner[node] = True
                    self.inner.append(False)
                node = nxt
            self.token_at[node] = r
        self._split()
        self.merged = {p[0] << 32 | p[1]: r for r, p in enumerate(self.parts) if p}
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _split(self) -> None:
        """The last merge of each token: (left, right), or none for single bytes."""
        self.parts: list[tuple[int, int] | None] = []
        for r, t in enumerate(self.tokens):
            parts = [t[i:i + 1] for i in range(len(t))]
            while len(parts) > 2:
                joins = [(self.rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)]
                best, i = min(joins)
                if best >= r:
                    raise ValueError(f"token {r} can't be reached by merges of lower rank")
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.parts.append((self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None)
            if self.parts[-1] and max(self.parts[-1]) >= r:
                raise ValueError(f"token {r} ranks before its own parts")

    def _ends(self, token: int) -> tuple[list, list]:
        """Right and left ends of the token's merge tree, each with the rank at which its parent forms."""
        known = self.spines.get(token)
        if known is None:
            known = ([], [])
            for side, ends in zip((1, 0), known):
                until, cur = 1 << 31, token
                while True:
                    ends.append((cur, until))
                    if self.parts[cur] is None:
                        break
                    until, cur = cur, self.parts[cur][side]
            self.spines[token] = known
        return known

    def _goes_with(self, a: int, b: int) -> bool:
        """May ``b`` follow ``a``: does no merge across the border come before both are whole?

        At equal rank the leftmost merge goes first.
        """
        merged = self.merged
        right_ends = self._ends(b)[1]
        for left, left_until in self._ends(a)[0]:
            left <<= 32
            for right, right_until in right_ends:
                c = merged.get(left | right)
                if c is not None and c < left_until and c <= right_until:
                    return False
        return True

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple]] = {}
        self.start = self._state(((-1, ROOT, ()),))

    def _state(self, guesses: tuple) -> int:
        known = self.ids.get(guesses)
        if known is None:
            known = self.ids[guesses] = len(self.states)
            self.states.append(guesses)
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        """Makes the transition: advance every guess, fork where a token ends, emit what all agree on.

        Guesses stand in the order of their start, so equal sets are equal tuples.
        """
        trie, token_at, inner, pairs = self.trie, self.token_at, self.inner, self.pairs
        out, fork = [], None
        for prev, node, held in self.states[state]:
            nxt = trie.get(node << 8 | byte)
            if nxt is None:
                continue
            if inner[nxt]:
                out.append((prev, nxt, held))
            tok = token_at[nxt]
            if tok >= 0 and fork is None:
                if prev >= 0:
                    pair = prev << 32 | tok
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) > MAX_PAIRS:
                            pairs.clear()
                        ok = pairs[pair] = self._goes_with(prev, tok)
                    if not ok:
                        continue
                fork = (tok, ROOT, held + (tok,))
        if fork is not None:
            out.append(fork)
        emitted = out[0][2]
        if emitted:
            for g in out[1:]:
                held = g[2]
                if held[:len(emitted)] != emitted:
                    n = 0
                    for x, y in zip(emitted, held):
                        if x != y:
                            break
                        n += 1
                    emitted = emitted[:n]
                    if not n:
                        break
            if emitted:
                n = len(emitted)
                out = [(p, d, h[n:]) for p, d, h in out]
        made = (self._state(tuple(out)), emitted)
        self.steps[state << 8 | byte] = made
        return made

    def encode(self, piece: bytes) -> list[int]:
        if len(self.steps) > self.most:
            self._clear()
        state, out, steps = self.start, [], self.steps
        for b in piece:
            nxt = steps.get(state << 8 | b)
            if nxt is None:
                if len(steps) > 2 * self.most:  # a single very long piece
                    guesses = self.states[state]
                    self._clear()
                    steps, state = self.steps, self._state(guesses)
                nxt = self._step(state, b)
            state, emitted = nxt
            if emitted:
                out.extend(emitted)
        for _, node, held in self.states[state]:
            if node == ROOT:
                out.extend(held)
        return out


# UTF-8 validity automaton: states are what may come next.  0 accepts, 1 rejects.
_OK, _BAD, _C1, _C2, _C3, _E0, _ED, _F0, _F4 = range(9)


def _utf8_table() -> np.ndarray:
    t = np.full((9, 256), _BAD, np.uint8)
    t[_OK, :0x80] = _OK
    t[_OK, 0xC2:0xE0] = _C1
    t[_OK, 0xE0:0xF0] = _C2
    t[_OK, 0xE0], t[_OK, 0xED] = _E0, _ED
    t[_OK, 0xF0:0xF5] = _C3
    t[_OK, 0xF0], t[_OK, 0xF4] = _F0, _F4
    t[_C1, 0x80:0xC0] = _OK
    t[_C2, 0x80:0xC0] = _C1
    t[_C3, 0x80:0xC0] = _C2
    t[_E0, 0xA0:0xC0] = _C1
    t[_ED, 0x80:0xA0] = _C1
    t[_F0, 0x90:0xC0] = _C2
    t[_F4, 0x80:0x90] = _C2
    return t


class Utf8Stream:
    """Decodes ids as they come; ``feed`` gives the text that is complete so far.

    Bytes that can't be UTF-8 become U+FFFD, as by ``bytes.decode(errors="replace")``.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        table = _utf8_table()
        self.next = np.empty((9, len(tokens)), np.uint8)
        for s in range(9):
            for i, t in enumerate(tokens):
                cur = s
                for b in t:
                    cur = table[cur, b]
                    if cur == _BAD:
                        break
                self.next[s, i] = cur
        self.plain = self.next[_OK] == _OK
        self.reset()

    def reset(self) -> None:
        self.state, self.held = _OK, b""

    def feed(self, ids: np.ndarray) -> str:
        raw = self.held + b"".join([self.tokens[i] for i in ids.tolist()])
        self._walk(ids)
        if self.state == _OK:
            self.held = b""
            return raw.decode("utf-8", "replace")
        cut = len(raw)
        if self.state != _BAD:  # an unfinished letter waits for its rest
            cut -= 1
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
        else:  # find by the plain decoder what is surely over
            import codecs

            d = codecs.getincrementaldecoder("utf-8")("replace")
            text = d.decode(raw)
            self.held, _ = d.getstate()
            self.state = self._after(self.held)
            return text
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def _after(self, held: bytes) -> int:
        table, s = _utf8_table(), _OK
        for b in held:
            s = int(table[s, b])
        return s

    def _walk(self, ids: np.ndarray) -> None:
        """Only tokens that hold part of a letter need single steps; a plain one leaves state 0 as it is."""
        odd = np.flatnonzero(~self.plain[ids])
        if self.state == _OK and not len(odd):
            return
        state, at, nxt = int(self.state), 0, self.next
        for i in odd.tolist():
            if state != _OK and i > at:
                state = _BAD
            if state == _BAD:
                break
            state, at = int(nxt[state, ids[i]]), i + 1
        if state not in (_OK, _BAD) and at < len(ids):
            state = _BAD
        self.state = state

    def finish(self) -> str:
        text = self.held.decode("utf-8", "replace")
        self.reset()
        return text


#: Texts of these characters only are split alike by ``re``, which is faster; all others by ``regex``.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01bf]")


class _Pieces(dict):
    """Ids (as bytes) of pieces met lately; a missing one goes through the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Splits texts by a pattern, encodes each piece, and decodes; pieces met lately are remembered."""

    def __init__(self, path: str, pattern: str, transitions: int | None = None, pieces: int | None = None):
        self.transducer = Transducer(read_ranks(path), transitions)
        self.most = pieces or MAX_PIECES
        self.tokens = self.transducer.tokens
        self.stream = Utf8Stream(self.tokens)
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")
                                    .replace(r"\S", r"\P{White_Space}"))
        fast = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.fast = None if r"\p" in fast else re.compile(fast)
        self.memo = _Pieces(self.transducer)

    def ids(self, text: str) -> np.ndarray:
        pieces = (self.fast if self.fast and not _OTHER.search(text) else self.pieces).findall(text)
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        return np.frombuffer(b"".join([memo[p] for p in pieces]), "<u4")

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> str:
        """Streams the ids through the UTF-8 machine in chunks."""
        self.stream.reset()
        parts = [self.stream.feed(ids[i:i + chunk]) for i in range(0, len(ids), chunk)]
        return "".join(parts) + self.stream.finish()


_CODECS: dict[tuple, Codec] = kept("bpe")


def codec(path: str, pattern: str, transitions: int | None = None, pieces: int | None = None) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (path, pattern, transitions, pieces)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True, transitions: int | None = None, pieces: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256), one row per input row; a null text has no tokens.

    ``path`` is a rank file every worker can read.  ``decoded_sha256`` is of
    the UTF-8 bytes decoded back from the ids.  ``with_ids=False`` leaves the
    ids out of the rows.  ``transitions`` and ``pieces`` bound the tables a
    worker keeps (about 0.5 and 0.2 KB an entry); they trade memory for time
    and never change a result.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern, transitions, pieces)
        n, a, b, every = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = c.ids(text)
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            if with_ids:
                every.append(ids.astype(np.int32))
        out = {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        return out | {"ids": every} if with_ids else out

    return map_batches(documents(docs, id_col, text_col), fields, run, rows=500, keep="bpe")
