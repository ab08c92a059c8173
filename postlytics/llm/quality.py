"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words.  Every passage is encoded
from its own characters and words (letter classes, word shapes, repeats); a
gated attention (tanh times sigmoid) weighs the encoded passages, and the
weighted sum is scored.  Only document labels train it: which passages matter
is learned.  Weights come from a bounded sample of labelled rows and are fitted
with numpy (Adam on the log loss); scoring is a pass over all texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import by_size, code_points, documents, map_batches, ship

PASSAGE = 64
#: Character classes: the counts of each over a passage are features.
SPACE, LINE, LOWER, UPPER, LETTER, DIGIT, STOP, EXCLAIM, QUOTE, BAR, MARK, OTHER = range(12)
CLASSES = 12
FEATURES = CLASSES + 8

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isspace():
                table[c] = LINE if ch == "\n" else SPACE
            elif ch.isalpha():
                table[c] = LOWER if ch.islower() else UPPER if ch.isupper() else LETTER
            elif ch.isnumeric():
                table[c] = DIGIT
            elif ch in ".,;:":
                table[c] = STOP
            elif ch in "!?":
                table[c] = EXCLAIM
            elif ch in "'\"()-’“”":
                table[c] = QUOTE
            elif ch in "|\\/<>[]{}":
                table[c] = BAR
            elif c < 0x3000 and unicodedata.category(ch)[0] in "PS":
                table[c] = MARK
        _CLASS = table
    return _CLASS


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of different values in each group."""
    key = np.sort((group.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order, and how many passages each text has (one of zeros for a text without words)."""
    codes = code_points("\n".join(texts) + "\n")
    cls = _classes()[codes]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    solid = cls > LINE
    head = solid & ~np.concatenate([[False], solid[:-1]])
    tail = solid & ~np.concatenate([solid[1:], [False]])
    starts, stops = np.flatnonzero(head), np.flatnonzero(tail) + 1
    of_text = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(of_text, minlength=len(texts))
    per = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(per) - per
    nth = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[of_text]
    of_word = base[of_text] + nth // PASSAGE
    total = int(per.sum())
    x = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return x, per
    # characters up to the next word belong to the passage of the word before
    word_of_char = np.maximum(np.cumsum(head) - 1, 0)
    of_char = of_word[word_of_char]
    counts = np.bincount(of_char * CLASSES + cls, minlength=total * CLASSES).reshape(total, CLASSES)
    words = np.bincount(of_word, minlength=total).astype(np.float32)
    chars = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    x[:, :CLASSES] = counts / chars
    some = np.maximum(words, 1)
    # word hashes from a running polynomial
    with np.errstate(over="ignore"):
        power = np.full(len(codes) + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        run = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        inverse = np.full(len(codes) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        h = (run[stops] - run[starts]) * inverse[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = of_word[1:] == of_word[:-1]
    length = (stops - starts).astype(np.float64)
    last = cls[stops - 1]
    at = CLASSES
    x[:, at] = np.bincount(of_word, length, total) / some / 10
    x[:, at + 1] = np.bincount(of_word, same, total) / some
    x[:, at + 2] = _distinct(of_word, h, total) / some
    x[:, at + 3] = _distinct(of_word[1:][inside], pair[inside], total) / np.maximum(words - 1, 1)
    x[:, at + 4] = np.bincount(of_word, (last >= BAR) & (length > 1), total) / some
    x[:, at + 5] = np.bincount(of_word, (cls[starts] >= BAR), total) / some
    upper = np.concatenate([[0], np.cumsum(cls == UPPER)])
    x[:, at + 6] = np.bincount(of_word, (upper[stops] - upper[starts] > 1), total) / some
    x[:, at + 7] = np.minimum(words / PASSAGE, 1)
    return x, per


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and attention of each passage."""
        if self.constant is not None:
            return np.full(len(per), self.constant), np.repeat(1 / per, per)
        out = _forward(self.weights, (x - self.mean) / self.std, per)
        return out["p"].astype(float), out["a"].astype(float)


def _forward(w: dict, x: np.ndarray, per: np.ndarray) -> dict:
    starts = np.cumsum(per) - per
    bag = np.repeat(np.arange(len(per)), per)
    h = np.tanh(x @ w["e"] + w["eb"])
    t = np.tanh(h @ w["v"] + w["vb"])
    g = 1 / (1 + np.exp(-(h @ w["u"] + w["ub"])))
    s = (t * g) @ w["w"]
    top = np.maximum.reduceat(s, starts)
    ex = np.exp(s - top[bag])
    a = ex / np.add.reduceat(ex, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "bag": bag, "starts": starts}


def _gradient(w: dict, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(w, x, per)
    bag, starts, h, a = f["bag"], f["starts"], f["h"], f["a"]
    d = (f["p"] - y) / len(y)
    grad = {"o": f["z"].T @ d, "ob": np.array(d.sum())}
    dz = d[:, None] * w["o"]
    dh = a[:, None] * dz[bag]
    da = (h * dz[bag]).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, starts)[bag])
    tg = f["t"] * f["g"]
    grad["w"] = tg.T @ ds
    dt = ds[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * w["w"] * tg * (1 - f["g"])
    grad["v"], grad["vb"] = h.T @ dt, dt.sum(axis=0)
    grad["u"], grad["ub"] = h.T @ dg, dg.sum(axis=0)
    dh += dt @ w["v"].T + dg @ w["u"].T
    dh *= 1 - h ** 2
    grad["e"], grad["eb"] = x.T @ dh, dh.sum(axis=0)
    return grad


def train(x: np.ndarray, per: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 20,
          batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits the model to bags; the same bags in the same order give the same model."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    if not len(y) or y.min() == y.max():
        return Model(mean, std, {}, float(y[0]) if len(y) else 0.5)
    x = ((x - mean) / std).astype(np.float32)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    w = {"e": rng.normal(0, d ** -0.5, (d, hidden)), "eb": np.zeros(hidden),
         "v": rng.normal(0, hidden ** -0.5, (hidden, attention)), "vb": np.zeros(attention),
         "u": rng.normal(0, hidden ** -0.5, (hidden, attention)), "ub": np.zeros(attention),
         "w": rng.normal(0, attention ** -0.5, attention), "o": rng.normal(0, hidden ** -0.5, hidden), "ob": np.zeros(())}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    begin = np.cumsum(per) - per
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            bags = order[lo:lo + batch]
            rows = np.concatenate([np.arange(begin[b], begin[b] + per[b]) for b in bags])
            grad = _gradient(w, x[rows], per[bags], y[bags].astype(np.float32))
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = (w[k] * (1 - lr * decay) - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Model(mean, std, w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "quality", max_rows: int = 12_000, max_passages: int = 400_000, **how) -> Model:
    """Fits on at most ``max_rows`` labelled rows, least ids by hash (the documented bound of the sample).

    Bags are read in order of their hash until ``max_passages`` passages are
    there; each bag is whole.  Null labels and labels without a document teach
    nothing; without labels every score is 0.5, with one label that label.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = (labels.select(F.col(f"`{label_id_col}`").cast("long").alias("sample_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
            .where("sample_id is not null and label is not null").groupBy("sample_id").agg(F.max("label").alias("label")))
    sample = rows.orderBy(F.xxhash64("sample_id"), "sample_id").limit(max_rows)
    bounded = spark.createDataFrame([(r["sample_id"], r["label"]) for r in sample.toLocalIterator()], "sample_id long, label int")
    texts = documents(docs, id_col, text_col).join(F.broadcast(bounded), F.col("doc_id") == F.col("sample_id"))

    def bags(batch: pa.RecordBatch) -> dict:
        x, per = encode(batch.column(1).to_pylist())
        ends = np.cumsum(per)
        return {"doc_id": batch.column(0), "label": batch.column(2),
                "x": [x[e - n:e].astype(np.float16).tobytes() for e, n in zip(ends.tolist(), per.tolist())]}

    got = map_batches(texts.select("doc_id", "text", "label"), "doc_id long, label int, x binary", bags, rows=200)
    xs, per, y, n = [], [], [], 0
    for r in got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").toLocalIterator():
        if n >= max_passages:
            break
        x = np.frombuffer(bytes(r["x"]), np.float16).reshape(-1, FEATURES)
        xs.append(x)
        per.append(len(x))
        y.append(int(r["label"] > 0))
        n += len(x)
    x = np.concatenate(xs).astype(np.float32) if xs else np.zeros((0, FEATURES), np.float32)
    if not len(x):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, 0.5)
    return train(x, np.array(per), np.array(y), **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", attention: bool = True) -> DataFrame:
    """(doc_id, score, attention), one row per input row; attention: a weight for each passage, in order.

    A null or empty text is one passage without words; equal texts get equal scores.
    """
    fields = "doc_id long, score double" + ", attention array<float>" * attention

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        scores, weights = [], []
        for lo, hi in by_size(texts, 1_000_000):
            x, per = encode(texts[lo:hi])
            p, a = model.scores(x, per)
            scores += p.tolist()
            if attention:
                weights += np.split(a, np.cumsum(per)[:-1])
        out = {"doc_id": batch.column(0), "score": scores}
        return out | {"attention": weights} if attention else out

    return map_batches(documents(docs, id_col, text_col), fields, run)
