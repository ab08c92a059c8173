"""Language of spans: script ranges narrow the candidates, Viterbi with a switching penalty labels the words.

A word's score for a language is the sum of the log shares of its letter
trigrams (word ends marked) among that language's trigrams in the labelled
rows.  A language is a candidate for a word only if the word's script makes up
a share of the language's letters; a script no language writes rules none out.
Viterbi over the words of a text, with a fixed penalty for each change of
language, gives the spans; the language with most letters is the prediction
and its share of the letters the score.

Viterbi runs as a max-plus product: texts are cut into segments of at most
``SEGMENT`` words, all segments of a batch advance together, and segment
results are joined in order.  That is exact and makes no difference between
one long text and many short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import by_size, code_points, documents, lower, map_batches, ship, slices, trimmed

BUCKETS = 1 << 14
SEGMENT = 256
UND = "und"
#: First code point, last code point, script.  Letters outside count as "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0x20000, 0x323AF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for _, _, s in SCRIPTS))

_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its script."""
    global _TABLES
    if _TABLES is None:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        for lo, hi, name in SCRIPTS:
            script[lo:hi + 1] = SCRIPT_NAMES.index(name)
        _TABLES = letter, script
    return _TABLES


def _grams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Over the joined lower-cased texts: trigram bucket of each letter, letter positions, scripts, text starts."""
    letter, script = _tables()
    joined = code_points("\0".join(lower(t) for t in texts) + "\0")
    is_letter = letter[joined]
    codes = np.where(is_letter, joined, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    prev = np.where(at > 0, codes[at - 1], 0).astype(np.uint32)
    h = (prev * np.uint32(0x9E3779B1)) ^ (codes[at] * np.uint32(0x85EBCA6B)) ^ (codes[at + 1] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(18)).astype(np.int32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return bucket, at, script[joined[at]], np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Model:
    """Log shares (languages x buckets), script bias (scripts x languages) and the names."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    penalty: float = 12.0


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = 12.0,
        least_share: float = 0.01) -> Model:
    """Trigram and script counts over *all* given rows with a language; the model is as large as the language list.

    Rows with a null text or language teach nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from postlytics.llm.common import spark_schema

    ship(rows.sparkSession)
    schema = "lang string, slot int, n long"
    arrow = to_arrow_schema(spark_schema(schema))
    width = BUCKETS + len(SCRIPT_NAMES)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, 1000)):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                acc = sums.setdefault(lang, np.zeros(width, np.int64))
                for lo, hi in by_size(texts):
                    bucket, _, script, _ = _grams(texts[lo:hi])
                    acc[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    acc[BUCKETS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for lang, acc in sums.items():
            slot = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()),
                                              pa.array(acc[slot], pa.int64())], schema=arrow)

    known = rows.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    counts = (known.where("text is not null and lang is not null").mapInArrow(trimmed(count), schema)
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    sums = np.zeros((len(langs), width))
    sums[[langs.index(x) for x in counts["lang"]], counts["slot"].to_numpy(dtype=int)] = counts["n"].to_numpy(dtype=float)
    grams, scripts = sums[:, :BUCKETS] + 0.5, sums[:, BUCKETS:]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    candidate = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= least_share).T
    candidate |= ~candidate.any(axis=1, keepdims=True)
    return Model(langs, table, np.where(candidate, 0, -1e4).astype(np.float32), penalty)


#: Up to so many languages segments of a text run side by side, for every language they may be entered in.
SIDE_BY_SIDE = 16


def _viterbi_by_text(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """``viterbi`` with one state a language: memory is the words times the languages."""
    labels = np.zeros(len(scores), np.int64)
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[:-1][order], sizes[order]
    langs = np.arange(scores.shape[1], dtype=np.min_scalar_type(scores.shape[1]))
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    v = scores[first].astype(np.float32)
    back = []
    for t, k in enumerate(active.tolist()):
        if not t:
            continue
        cur = v[:k] - v[:k].max(axis=1, keepdims=True)
        stay = cur >= -penalty
        back.append(np.where(stay, langs, cur.argmax(axis=1).astype(langs.dtype)[:, None]))
        v[:k] = np.where(stay, cur, np.float32(-penalty)) + scores[first[:k] + t]
    now = v.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        labels[first[:k] + t] = now[:k]
        if t:
            now[:k] = back[t - 1][np.arange(k), now[:k]]
    return labels


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of many texts at once; ``starts`` are the texts' first words, ends included."""
    n, langs = scores.shape
    labels = np.zeros(n, np.int64)
    if not n or langs < 2:
        return labels
    if langs > SIDE_BY_SIDE:
        return _viterbi_by_text(scores, starts, penalty)
    sizes = np.diff(starts)
    per = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = starts[text] + nth * SEGMENT
    length = np.minimum(SEGMENT, starts[text + 1] - first)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    eye = np.where(np.eye(langs, dtype=bool), 0, -np.inf).astype(np.float32)
    v = np.broadcast_to(eye, (len(first), langs, langs)).copy()  # by segment, entry language, language now
    steps = int(length[0])
    back = np.zeros((steps, len(first), langs, langs), np.uint8)
    ids = np.arange(langs, dtype=np.uint8)
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    for t in range(steps):
        k = active[t]
        cur = v[:k]
        best, arg = cur.max(axis=2, keepdims=True) - penalty, cur.argmax(axis=2).astype(np.uint8)[..., None]
        stay = cur >= best
        back[t, :k] = np.where(stay, ids, arg)
        v[:k] = np.where(stay, cur, best) + scores[first[:k] + t][:, None, :]
    # join the segments of each text, then walk back
    total = np.zeros((len(sizes), langs), np.float32)
    begin = np.cumsum(per) - per
    entry = np.zeros((len(first), langs), np.int64)
    for r in range(int(per.max())):
        live = np.flatnonzero(per > r)
        seg = where[begin[live] + r]
        sums = total[live][:, :, None] + v[seg]
        entry[seg] = sums.argmax(axis=1)
        total[live] = sums.max(axis=1)
        total[live] -= total[live].max(axis=1, keepdims=True)
    leave, enter = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    now = total.argmax(axis=1)
    for r in range(int(per.max()) - 1, -1, -1):
        live = np.flatnonzero(per > r)
        seg = where[begin[live] + r]
        leave[seg] = now[live]
        enter[seg] = now[live] = entry[seg, now[live]]
    cur = leave.copy()
    for t in range(steps - 1, -1, -1):
        k = active[t]
        labels[first[:k] + t] = cur[:k]
        cur[:k] = back[t, np.arange(k), enter[:k], cur[:k]]
    return labels


def label_texts(texts: list[str], model: Model, spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
    bucket, at, script, begin = _grams(texts)
    preds, scores, found = [UND] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not len(at) or not model.langs:
        return preds, scores, found
    head = np.concatenate([[True], np.diff(at) > 1])
    words = np.flatnonzero(head)
    w = np.empty((len(words), len(model.langs)), np.float32)
    for i, row in enumerate(model.table):
        w[:, i] = np.add.reduceat(row[bucket], words)
    w += model.bias[script[words]]
    letters = np.diff(np.append(words, len(at)))
    word_at = at[words]
    starts = np.searchsorted(word_at, begin)
    full = np.flatnonzero(np.diff(starts))
    labels = viterbi(w, np.append(starts[full], starts[-1]), model.penalty)
    of_text = np.searchsorted(begin, word_at, side="right") - 1
    share = np.zeros((len(texts), len(model.langs)), np.int64)
    np.add.at(share, (of_text, labels), letters)
    for i in full.tolist():
        best = int(share[i].argmax())
        preds[i], scores[i] = model.langs[best], float(share[i, best] / share[i].sum())
        if spans:
            lo, hi = starts[i], starts[i + 1]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(labels[lo:hi])) + 1, [hi - lo]]) + lo
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                found[i].append({"lang": model.langs[labels[a]], "start": int(word_at[a] - begin[i]),
                                 "end": int(word_at[b - 1] + letters[b - 1] - begin[i])})
    return preds, scores, found


def _label(texts: list[str], model: Model, spans: bool) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    for lo, hi in by_size(texts):
        for acc, part in zip(out, label_texts(texts[lo:hi], model, spans)):
            acc += part
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans), one row per input row.

    ``und`` with score 0 and no spans if the text is null, empty or has no
    letter, or if nothing was learned; equal shares go to the first language
    by name; repeated rows give repeated rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        pred, score, found = _label(batch.column(1).to_pylist(), model, spans)
        return {"doc_id": batch.column(0), "lang_pred": pred, "score": score} | ({"spans": found} if spans else {})

    fields = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans
    return map_batches(documents(docs, id_col, text_col), fields, run)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.4, least_span: int = 100) -> DataFrame:
    """Rows of ``docs`` whose text has languages of its own.

    Rejected: ``und``, and texts of which no language has ``least_score`` of the letters, unless as much lies in spans of
    ``least_span`` characters (a text in several languages, each for a stretch, stays).
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def known(pred: str, score: float, text: str, spans: list[dict]) -> bool:
        long = sum(s["end"] - s["start"] for s in spans if s["end"] - s["start"] >= least_span)
        return pred != UND and (score >= least_score or long >= least_score * len(text))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1000):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                pred, score, _ = _label(texts, model, False)
                keep = [p != UND and s >= least_score for p, s in zip(pred, score)]
                rest = [i for i, (k, p) in enumerate(zip(keep, pred)) if not k and p != UND]
                for i, p, s, spans in zip(rest, *_label([texts[i] for i in rest], model, True)):
                    keep[i] = known(p, s, texts[i], spans)
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
