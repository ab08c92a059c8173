"""Token ids of a corpus as Parquet list columns that can be read in part.

``write`` puts the documents in ascending id order over range partitions, encodes them in tasks and lets Spark's
Parquet writer lay them out: version 2 pages, token lists dictionary- or delta-encoded, ids, lengths and places
delta-encoded, row groups and pages of the size asked for.  The writer adds page indexes by itself.  ``index``
reads the columns of numbers only, and ``tokens`` a range of ids: rows lie in id order, so row groups and pages
outside it are skipped.

Rules: a null text is the empty text.  Every document ends with ``end_id``, so an empty one has that id only.  Rows
without an id come first.  Rows of one id lie side by side, in the order of their texts' hash.  An empty table
gives an empty table.  Only the named columns are read.

A row is (doc_id, shard, place, n_tokens, tokens): ``place`` counts the ids before it in its shard (one task's
file); ids before the shard follow from the lengths of the shards before, which ``index`` adds.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlytics.llm.common import by_size, map_batches, ship

SCHEMA = "doc_id long, shard int, place long, n_tokens int, tokens array<int>"
NUMBERS = ("doc_id", "shard", "place", "n_tokens")
KNOWN = 400_000  # words of each of the two generations that a worker remembers
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)


class _Alphabet(dict):
    """``str.translate`` table from code points to the vocabulary's byte alphabet, in lower case.

    Holds printable ASCII and letters that neither compose nor change in number, as the library maps them one
    by one; any other character raises ``ValueError``.
    """

    def __init__(self, tokenizer):
        super().__init__({c: chr(c).lower() for c in range(33, 127)} | {10: "\n"})
        self.normal, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        char = chr(code)
        jamo = 0x1100 <= code <= 0x11FF or 0xA960 <= code <= 0xA97F or 0xD7B0 <= code <= 0xD7FF
        low = self.normal(char)
        if unicodedata.category(char) not in ("Ll", "Lu", "Lo") or jamo or len(low) != 1 or unicodedata.normalize("NFC", char) != char:
            raise ValueError(char)
        words = self.cut(f"a{low}a")
        if len(words) != 1:
            raise ValueError(char)
        self[code] = words[0][0][1:-1]
        return self[code]

    def plain(self, code: int) -> bool:
        try:
            return bool(self[code])
        except ValueError:
            return False


class Encoder:
    """Ids of whole texts as ``tokenizer.encode(text, add_special_tokens=False)`` gives them.

    For a vocabulary whose pre-tokens never hold white space and whose normaliser works within what white space
    parts.  All texts of a batch are cut at once, on their bytes: into the pre-tokens of the vocabulary's expression
    ('s 't 're 've 'm 'll 'd, runs of letters, single digits, runs of anything else), and each distinct one goes
    through the library's model once for as long as it is remembered.  What lies between ASCII white space and
    holds anything but printable ASCII and plain letters, or may hold an added token, stays whole and goes
    through the library's own normaliser and pre-tokeniser, or through ``encode``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = sorted({t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.alphabet = _Alphabet(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.kind = np.full(256, HARD, np.uint8)
        self.kind[list(b" \t\n\v\f\r")] = SPACE
        self.kind[33:127] = OTHER
        self.kind[[c for c in range(128) if chr(c).isalpha()]] = LETTER
        self.kind[48:58] = DIGIT
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.plain = np.zeros(0x110000, np.int8)  # 1 a plain letter, -1 not, 0 not asked yet

    def _words(self, raw: bytes) -> list[str]:
        """Pre-tokens of what lies between white space, in the byte alphabet."""
        text = raw.decode()
        try:
            return [text.translate(self.alphabet)]
        except ValueError:
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def _ids(self, some: list[bytes]) -> list[bytes]:
        """Ids of new words; a run of plain ones is mapped to the byte alphabet at once."""
        joined = b"\n".join(some)
        marked = any(m in joined for m in self.marks)
        try:
            plain = None if marked else joined.decode().translate(self.alphabet).split("\n")
        except ValueError:
            plain = None
        if plain is not None:
            return [array("I", [t.id for t in self.model.tokenize(w)]).tobytes() for w in plain]
        return [array("I", self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids if any(m in raw for m in self.marks)
                      else [t.id for w in self._words(raw) for t in self.model.tokenize(w)]).tobytes() for raw in some]

    def _lookup(self, words: list[bytes]) -> list[bytes]:
        out = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if self.old:
            for i in new:
                if (ids := self.old.get(words[i])) is not None:
                    out[i] = self.known[words[i]] = ids
            new = [i for i in new if out[i] is None]
        for lo in range(0, len(new), 100):
            some = new[lo:lo + 100]
            for i, ids in zip(some, self._ids([words[i] for i in some])):
                out[i] = ids
                if len(words[i]) <= 40:
                    self.known[words[i]] = ids
        if len(self.known) >= KNOWN:
            self.old, self.known = self.known, {}
        return out

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        """Kind of each byte; bytes of a plain letter above ASCII are letters, those of any other character hard."""
        kind = self.kind[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
            first, size = b[lead], 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
            code = np.choose(size - 2, [first & 0x1F, first & 0x0F, first & 0x07])
            for i in (1, 2, 3):
                code = np.where(size > i, (code << 6) | (b[np.minimum(lead + i, len(b) - 1)] & 0x3F), code)
            for c in np.unique(code[self.plain[code] == 0]).tolist():
                self.plain[c] = 1 if self.alphabet.plain(c) else -1
            ok = self.plain[code] > 0
            lead, size = lead[ok], size[ok]
            for i in range(4):
                kind[(lead + i)[size > i]] = LETTER
        mark = np.zeros(len(raw), bool)
        for m in self.marks:
            mark[:-1] |= (raw[:-1] == m[0]) & (raw[1:] == m[1])
        kind[mark] = HARD
        return kind

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and their number for each text."""
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = self._kinds(raw)
        # starts of segments: where the kind changes or a digit stands
        cut = np.empty(len(raw), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == DIGIT
        low = self.low[raw]
        mark = np.flatnonzero((low == 39) & cut)
        mark = mark[mark + 2 < len(raw)]
        a, b = low[mark + 1], low[mark + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        cut[mark[one | two] + 1] = False
        after = np.concatenate([mark[one] + 2, mark[two] + 3])
        cut[after[after < len(raw)]] = True
        if (kind == HARD).any():  # what holds a hard byte stays whole
            word = kind != SPACE
            edge = np.flatnonzero(np.diff(word, prepend=False))
            starts = edge[::2]
            stops = np.append(edge[1::2], len(raw))[:len(starts)]
            hard = np.add.reduceat((kind == HARD).astype(np.int64), starts) > 0
            flip = np.zeros(len(raw) + 1, np.int8)
            flip[starts[hard]] += 1
            flip[stops[hard]] -= 1
            cut &= np.cumsum(flip[:-1], dtype=np.int8) == 0
            cut[starts[hard]] = True
            cut[stops[hard]] = True
        at = np.flatnonzero(cut)
        solid = np.flatnonzero(kind[at] != SPACE)
        all_ = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(low)])
        solid_at = at[solid]
        coded = all_.take(pa.array(solid)).dictionary_encode()
        found = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(found), np.uint32)
        size = np.array([len(x) >> 2 for x in found], np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        each = size[which]
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        ids = flat[np.repeat(begin[which] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(solid_at, ends)], prepend=0)

    def __call__(self, raw: bytes) -> list[int]:
        return self.batch([raw])[0].tolist()


_ENCODER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[path] = Encoder(path)
    return _ENCODER[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded documents in ascending id order over the partitions; columns of ``SCHEMA``."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # rows of one id, and of none, may be many: the hash and the row's number part them
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        shard, place, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        gc.disable()  # many small lasting objects: nothing to collect
        try:
            for whole in batches:
                texts = whole.column("text").cast(pa.binary()).to_pylist()
                for lo, hi in by_size(texts, 4_000_000):
                    ids, n = encoder.batch(texts[lo:hi])
                    ids = np.insert(ids, np.cumsum(n), end_id).astype(np.int32)
                    n += 1
                    offsets = np.concatenate([[0], np.cumsum(n)])
                    yield pa.RecordBatch.from_arrays(
                        [whole.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, shard, np.int32)),
                         pa.array(place + offsets[:-1]), pa.array(n.astype(np.int32)),
                         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))],
                        ["doc_id", "shard", "place", "n_tokens", "tokens"])
                    place += int(offsets[-1])
        finally:
            gc.enable()

    return rows.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "dictionary", row_group_bytes: int = 8 << 20,
          page_bytes: int = 64 << 10, page_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the token files to ``path``; ``encoding`` of the token lists is dictionary or delta."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    (encode(docs, tokenizer, end_id, id_col, text_col).write
     .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows).parquet(path))


def _shard_starts(files: DataFrame) -> DataFrame:
    """(shard, before): ids in the shards before; one row a file."""
    ends = files.groupBy("shard").agg(F.max(F.col("place") + F.col("n_tokens")).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document, from the columns of numbers alone."""
    files = spark.read.parquet(path).select(*NUMBERS)
    return files.join(F.broadcast(_shard_starts(files)), "shard").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"))


def tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, tokens) of the documents with ids from ``first`` to ``last``; the bounds reach the page indexes."""
    files = spark.read.parquet(path)
    starts = _shard_starts(files.select(*NUMBERS))
    if first is not None:
        files = files.where(F.col("doc_id") >= first)
    if last is not None:
        files = files.where(F.col("doc_id") <= last)
    return files.join(F.broadcast(starts), "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "tokens")


def summary(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as ``tokens`` gives them."""
    def fn(batch: pa.RecordBatch) -> dict:
        lists = batch.column("tokens")
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy(zero_copy_only=False)])).tolist()
        view = memoryview(ids).cast("B")
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": np.diff(ends),
                "ids_crc32": [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(ends, ends[1:])]}

    return map_batches(rows, "doc_id long, start long, n_tokens long, ids_crc32 long", fn)


