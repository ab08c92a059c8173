"""Messy CSV exports -> typed DataFrame.

1. One job over the text of all files finds, for every file, whether all of
   it is valid UTF-8 and its first records, and for every split of a file
   whether it ends inside quotes, for either way of being entered; one small
   row a file reaches the driver, as it does in Spark's own file index.
2. An ordered prefix over the splits of a file gives each split's true entry
   state.  Then every task joins the lines of its split to records (captions
   may hold line breaks); the pieces of a record that crosses splits are put
   together by its first split.  All records are staged as one Parquet table
   in the shared folder, which also gives every record its id.
3. Each header group's types (number or not, which date format) come from one
   aggregate over its staged columns; the conversion is a single ``select``
   (``kept`` writes its rows for more than one question).
"""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.functions.columns import ntz_text, strip, to_double_guarded
from postlytics.operators.roles import (
    DATE_NAME_KEYWORDS,
    HEADER_KEYWORDS,
    clean_names,
    dedupe_names,
    detect_content_type,
)
from postlytics.session import checkpoint_dir, cut_lineage

# The text cells pandas reads as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SAMPLE_RECORDS = 10
HEADER_CANDIDATES = 5

#: Lines of a file from which its header is found.
SAMPLE_LINES = 40

# Timestamp patterns.  Year first and month names are read alike in every
# column; the others are tried as one family per column (day first wins ties).
# The layouts platform exports use.
_CLOCKS = ["", " H:mm[:ss]", " h:mm[:ss] a"]
PLAIN_PATTERNS = [f"{d}{t}" for d in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy") for t in _CLOCKS]
FAMILIES = {name: [day + t for t in _CLOCKS] for name, day in
            (("dmy_slash", "d/M/yyyy"), ("dmy_dash", "d-M-yyyy"), ("dmy_dot", "d.M.yyyy"), ("mdy_slash", "M/d/yyyy"))}
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


# ------------------------------------------------------------------ S2 / S3 / S4
def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """File listing (path, modificationTime, length); the content column is pruned."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def latest_file(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Newest export by modification time (one row); error when none."""
    files = list_files(spark, path, glob)
    if not files.limit(1).take(1):  # a file listing, no content is read
        raise FileNotFoundError(f"no {glob} files under {path}")
    return files.agg(F.max_by("path", "modificationTime").alias("path"),
                     F.max("modificationTime").alias("modificationTime")).where(F.col("path").isNotNull())


@dataclass(frozen=True)
class FileHead:
    """What the first job learns about a file."""

    path: str
    encoding: str
    header: tuple[str, ...]
    cr_only: bool = False  # lines end in a lone carriage return: such a file can't be split
    crossing: bool = False  # some record goes on behind its split


def find_header_row(records: list[list[str]], candidates: int = HEADER_CANDIDATES) -> int:
    """Of the first records the one that mentions most keywords; the first of several, or if none does."""
    def mentions(i: int) -> int:
        text = "\n".join(records[i]).lower()
        return sum(k in text for k in HEADER_KEYWORDS)

    return max(range(min(candidates, len(records))), key=lambda i: (mentions(i), -i))


def _records(lines: list[bytes], encoding: str) -> list[list[str]]:
    text = b"\n".join(lines).decode(encoding, "replace").removeprefix("\ufeff")
    return [r for r in csv.reader(io.StringIO(text)) if any(x.strip() for x in r)][:SAMPLE_RECORDS]


# What a line does to the state "inside quotes", as the CSV parser sees it: a quote opens a field only where the field begins,
# a doubled quote is text, and what follows a closing quote belongs to the field up to the comma.
_QUOTED = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
OPENS = rf'\A{_FIELDS}"{_QUOTED}\z'
STAYS = rf'\A{_QUOTED}(?:\z|"[^,]*+,{_FIELDS}"{_QUOTED}\z)'


def line_flow(line: Column) -> tuple[Column, Column]:
    """Is the end of a line inside quotes, if it is entered outside (first) or inside (second) of them?"""
    quote = F.contains(line, F.lit('"'))
    return quote & line.rlike(OPENS), ~quote | line.rlike(STAYS)


def flow_states(opens, stays, entry: int):
    """State after each of a run of lines, from the state before the first: the last line that decides the state whatever
    it was before, turned by the lines since then that swap both states."""
    import numpy as np

    fixed, swaps = opens == stays, np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(opens)), -1))
    base = np.where(last >= 0, opens[last], entry)
    return (base + swaps - np.where(last >= 0, swaps[last], 0)) & 1


def _runs(*keys):
    """(from, to) of the stretches of equal neighbours."""
    import numpy as np

    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _lines(spark: SparkSession, files: str | list[str], glob: str | None = None) -> DataFrame:
    """Every line of the files with its split and its flow; a carriage return before the line feed is still there."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    opens, stays = line_flow(F.col("value"))
    return reader.text(files).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), "value", opens.alias("opens"), stays.alias("stays"))


def _split_rows(batches):
    """One row for each split in this task: are all lines UTF-8, its exit states for both entry states, the first lines if it
    begins the file, and whether those end in lone carriage returns."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bad", pa.int32()),
                        ("from_out", pa.int32()), ("from_in", pa.int32()), ("cr_only", pa.int32()), ("lines", pa.list_(pa.binary()))])
    seen: dict[tuple, list] = {}
    for batch in batches:
        path, starts, lengths = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        ok, line = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
        opens, stays = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
        names = path.dictionary_encode().indices.to_numpy()
        for a, b in _runs(names, starts):
            key = (path[a].as_py(), int(starts[a]), int(lengths[a]))
            at = seen.setdefault(key, [0, 0, 1, 0, []])
            at[0] |= int(not np.all(ok[a:b]))
            at[1], at[2] = (int(flow_states(opens[a:b], stays[a:b], e)[-1]) for e in at[1:3])
            if key[1] == 0 and len(at[4]) < SAMPLE_LINES:
                for text in line.slice(a, min(b - a, SAMPLE_LINES - len(at[4]))).to_pylist():
                    parts = text.removesuffix(b"\r").split(b"\r")
                    at[3] |= int(len(parts) > 1 and parts[0].count(b'"') % 2 == 0)
                    at[4] += parts[:SAMPLE_LINES]
    yield pa.RecordBatch.from_pylist(
        [{"path": k[0], "start": k[1], "length": k[2], "bad": v[0], "from_out": v[1], "from_in": v[2], "cr_only": v[3],
          "lines": v[4][:SAMPLE_LINES]} for k, v in seen.items()], schema=schema)


def entry_states(splits: DataFrame) -> DataFrame:
    """Adds ``inside``: is a split entered inside quotes?  A prefix over the splits of a file, by the rule of ``flow_states``."""
    of_file = Window.partitionBy("path").orderBy("start")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("long")
    s = splits.withColumn("swaps", F.sum(swap).over(of_file.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "swaps"))
    s = s.withColumn("last", F.last(fixed, ignorenulls=True).over(before)).withColumn("turns", F.last("swaps").over(before))
    entry = (F.coalesce(F.col("last.from_out"), F.lit(0)) + F.coalesce("turns", F.lit(0)) - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2
    return s.withColumn("inside", entry == 1).drop("last", "turns", "swaps")


def scan_splits(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """A row a split of all files, from one job over their whole content."""
    lines = _lines(spark, path, glob)
    first = F.when(F.col("start") == 0, F.col("value").cast("binary"))  # only a file's first split can hold its header
    found = lines.select("path", "start", "length", F.is_valid_utf8("value"), first, "opens", "stays").mapInArrow(
        _split_rows, "path string, start long, length long, bad int, from_out int, from_in int, cr_only int, lines array<binary>")
    return cut_lineage(entry_states(found).withColumn("split", F.xxhash64("path", "start")))


def _heads(splits: DataFrame) -> list[FileHead]:
    """A row a file from its splits' rows."""
    out = []
    by_file = splits.groupBy("path").agg(F.max("bad").alias("bad"), F.max("cr_only").alias("cr_only"),
                                         F.max("inside").alias("crossing"), F.max_by("lines", -F.col("start")).alias("lines"))
    for r in sorted(by_file.collect(), key=lambda r: r["path"]):  # a row a file
        encoding = "ISO-8859-1" if r["bad"] else "UTF-8"
        records = _records([bytes(x) for x in r["lines"]], encoding)
        if records:
            out.append(FileHead(r["path"], encoding, tuple(records[find_header_row(records)]), bool(r["cr_only"]), r["crossing"]))
    return out


def scan_heads(spark: SparkSession, path: str, glob: str = "*.csv") -> list[FileHead]:
    """S3 + S4 for all files in one job over their whole content, in order of their paths.

    UTF-8 (a byte order mark is cut) if every line of the file is, else
    Latin-1, which decodes any byte.  A file without any record is left out.
    """
    return _heads(scan_splits(spark, path, glob))


# ------------------------------------------------------------------ S1 / S5 / S6
def _too_long(raw: Column, width: int) -> Column:
    """Does a raw record have more fields than the header?  An empty field counts."""
    bare = F.regexp_replace(raw, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= width


def _join_lines(batches):
    """Lines of a task's splits -> records (kind 0), a record that goes on behind the split (1), the rest of one begun before (2)."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("split", pa.int64()), ("kind", pa.int32()), ("line", pa.binary())])

    def out(split, kinds, lines):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(lines), split), pa.int64()), pa.array(kinds, pa.int32()),
                                           lines if isinstance(lines, pa.Array) else pa.array(lines, pa.binary())], schema=schema)

    split, state, open_lines, began = None, 0, [], False
    for batch in batches:
        ids, inside, line = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        opens, stays = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        for a, b in _runs(ids):
            if ids[a] != split:
                if open_lines:
                    yield out(split, [1 if began else 2], [b"\n".join(open_lines)])
                split, state, open_lines, began = int(ids[a]), int(inside[a]), [], False
            states = flow_states(opens[a:b], stays[a:b], state)
            if state == 0 and not states.any():
                yield out(split, np.zeros(b - a, np.int32), line.slice(a, b - a))
                continue
            kinds, lines = [], []
            for text, after in zip(line.slice(a, b - a).to_pylist(), states.tolist()):
                if not open_lines:
                    began = state == 0
                open_lines.append(text)
                if not after:
                    kinds.append(0 if began else 2)
                    lines.append(b"\n".join(open_lines))
                    open_lines = []
                state = after
            if lines:
                yield out(split, kinds, lines)
    if open_lines:
        yield out(split, [1 if began else 2], [b"\n".join(open_lines)])


#: How records are read, whichever way they are cut out of the files.
_CSV = {"header": "false", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}


def _fields(width: int) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*[f"_c{i}" for i in range(width)], "_raw"]])


def _split_records(spark: SparkSession, files: list[str], encoding: str, splits: DataFrame) -> DataFrame:
    """The records of files in splits, as text, with the pieces of those that cross splits (``_kind`` 1 and 2)."""
    changed = F.raise_error(F.lit("the files' splits changed between two scans: set spark.sql.files.minPartitionNum")).cast("boolean")
    # a row a split: a path, three numbers
    lines = _lines(spark, files).join(F.broadcast(splits), ["path", "start", "length"], "left").select(
        F.coalesce("split", F.lit(0)).alias("split"), F.coalesce("inside", changed).alias("inside"),
        F.col("value").cast("binary").alias("line"), "opens", "stays")
    records = lines.mapInArrow(_join_lines, "split long, kind int, line binary")
    text = F.col("line").cast("string") if encoding == "UTF-8" else F.decode("line", encoding)
    named = splits.select("split", F.col("path").alias("_file"), F.col("start").alias("_task"))
    return records.join(F.broadcast(named), "split").select("_file", "_task", F.col("kind").alias("_kind"), text.alias("_text"))


def _parse_text(records: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """Records in ``_text`` -> their fields; an empty line is no record."""
    bare = F.when(F.coalesce(F.col("_kind") == 0, F.lit(True)), F.regexp_replace("_text", r"\r\z", "")).otherwise(F.col("_text"))
    df = records.withColumn("_text", bare).where(F.col("_text") != "")
    csv_ = F.from_csv(F.when(F.col("_kind") == 0, F.col("_text")), _fields(len(header)).simpleString()[7:-1].replace(":", " "),
                      {**_CSV, "multiLine": "true"})
    df = df.withColumn("_r", csv_).select("*", "_r.*").drop("_r").withColumn("_text", F.when(F.col("_kind") != 0, F.col("_text")))
    return _checked(df, header)


def _checked(df: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """S5 on parsed records: over-long ones go; marks the header."""
    df = df.where(F.col("_raw").isNull() | ~_too_long(F.col("_raw"), len(header))).drop("_raw")
    df = df.withColumn("_c0", F.regexp_replace(F.col("_c0"), "^\ufeff", ""))
    is_header = F.lit(True)
    for i, text in enumerate(header):
        is_header = is_header & (F.coalesce(F.col(f"_c{i}"), F.lit("")) == F.lit(text))
    return df.withColumn("_is_header", is_header)


def _parsed(spark: SparkSession, files: list[str], encoding: str, header: tuple[str, ...], multi_line: bool) -> DataFrame:
    """S1 + S5: the records of all files of one encoding and header, as text, over-long ones dropped, short ones filled
    with nulls; records before the header are still there."""
    df = (spark.read.schema(_fields(len(header))).options(**_CSV).option("multiLine", multi_line).option("encoding", encoding)
          .csv(files).withColumn("_file", F.col("_metadata.file_path")).withColumn("_task", F.col("_metadata.file_block_start")))
    return _checked(df, header).withColumns({"_kind": F.lit(0), "_text": F.lit(None).cast("string")})


def _put_together(pieces: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """Records that cross splits: the piece that begins one and the rests up to the next beginning, in order of their splits."""
    order = Window.partitionBy("_file").orderBy("_task", F.desc("_kind"))
    record = pieces.withColumn("__n", F.sum((F.col("_kind") == 1).cast("int")).over(order)).groupBy("_file", "__n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_task", "_text"))), lambda x: x["_text"]), "\n").alias("_text"),
        F.min_by("_row_id", "_task").alias("_row_id"), F.min("_task").alias("_task"), F.lit(0).alias("_kind"))
    return _parse_text(record.drop("__n"), header)


def _after_header(df: DataFrame, files: int) -> DataFrame:
    """The records after each file's header, by split (``_task``) and place; a file whose header isn't found again keeps
    all its records."""
    starts = df.where("_is_header").groupBy("_file").agg(F.min(F.struct("_task", "_row_id")).alias("__h"))
    if files <= MAX_BROADCAST_FILES:  # one row a file at most
        starts = F.broadcast(starts)
    keep = F.col("__h").isNull() | (F.struct("_task", "_row_id") > F.col("__h"))
    return df.join(starts, "_file", "left").where(keep).drop("__h", "_task", "_is_header", "_file")


MAX_BROADCAST_FILES = 100_000


def null_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """pandas' default missing-value strings become null (exact match)."""
    return df.withColumns({c: F.when(F.col(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c))
                           for c in columns})


def _name_columns(df: DataFrame, header: list[str]) -> DataFrame:
    names = dedupe_names(clean_names([h if h else f"unnamed_{i}" for i, h in enumerate(header)]))
    return df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], "_row_id")


# ------------------------------------------------------------------ P1 / P2 / P3 / P4
def is_id_column(name: str) -> bool:
    """P1 (D9): a column is an id when ``id`` is one of its name tokens."""
    return "id" in name.lower().split("_")


def clean_ids(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Id columns stay text, a trailing ``.0`` is cut; null stays null."""
    cols = columns if columns is not None else [c for c in df.columns if is_id_column(c) and c != "_row_id"]
    return df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") for c in cols}) if cols else df


def _smart_parse(c: Column) -> tuple[Column, Column, Column]:
    """(plain parse, parse after unit clean-up, has-unit-character flag) for one text column."""
    s = strip(c)
    plain = to_double_guarded(s)
    s2 = F.regexp_replace(s, r"[,%$]", "")
    # The unit suffixes, lower case only.
    k = F.regexp_extract(s2, r"^(\d+\.?\d*)k$", 1)
    m = F.regexp_extract(s2, r"^(\d+\.?\d*)m$", 1)
    unit = (F.when(s2.rlike(r"^\d+\.?\d*k$"), k.cast("double") * F.lit(1000.0))
            .when(s2.rlike(r"^\d+\.?\d*m$"), m.cast("double") * F.lit(1000000.0))
            .otherwise(to_double_guarded(s2)))
    flag = s.rlike(r"[%,$kKmM]")
    return plain, unit, flag


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _is_date_name(name: str) -> bool:
    return any(k in name.lower() for k in DATE_NAME_KEYWORDS)


def type_columns(df: DataFrame, ratio: float = 0.6, numbers: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """P2 + P3: one aggregate decides every column, one select converts.

    A column becomes double when at least ``ratio`` of *all* rows parse; if any
    cell holds one of ``% , $ k K m M`` the unit clean-up (drop ``, % $``,
    expand ``k`` / ``m``) applies to the whole column.  A date column that
    stays text is parsed by the family of formats that reads most of its cells.
    """
    numbers = [c for c in _text_columns(df) if not is_id_column(c)] if numbers is None else numbers
    dates = [c for c in _text_columns(df) if _is_date_name(c)] if dates is None else dates
    aggs = []
    for i, c in enumerate(numbers):
        plain, unit, flag = _smart_parse(F.col(c))
        aggs += [F.max(flag.cast("int")).alias(f"f{i}"), F.avg(plain.isNotNull().cast("double")).alias(f"p{i}"),
                 F.avg(unit.isNotNull().cast("double")).alias(f"u{i}")]
    for i, c in enumerate(dates):
        aggs += [F.count(_first_parse(strip(F.col(c)), pats)).alias(f"d{i}_{j}") for j, pats in enumerate(FAMILIES.values())]
    if not aggs:
        return df
    row = df.agg(*aggs).first()
    conv = {}
    for i, c in enumerate(numbers):
        has_unit = bool(row[f"f{i}"])
        share = row[f"u{i}"] if has_unit else row[f"p{i}"]
        if share is not None and share >= ratio:
            plain, unit, _ = _smart_parse(F.col(c))
            conv[c] = unit if has_unit else plain
    families = list(FAMILIES.values())
    for i, c in enumerate(dates):
        if c not in conv:
            best = max(range(len(families)), key=lambda j: (row[f"d{i}_{j}"], -j))
            conv[c] = _date_of(F.col(c), families[best])
    return df.withColumns(conv) if conv else df


def smart_numeric(df: DataFrame, ratio: float = 0.6, exclude: list[str] | None = None) -> DataFrame:
    """P2 alone."""
    cols = [c for c in _text_columns(df) if not is_id_column(c) and c not in (exclude or [])]
    return type_columns(df, ratio, cols, [])


def _may_have(c: Column, pattern: str) -> Column:
    """What a text of a pattern has at least: its separator, a month's letters, a clock, letters at its end.

    A failed parse costs an exception in the parser, some ten times a parse that succeeds.
    """
    out = F.contains(c, F.lit(":")) if ":" in pattern else ~F.contains(c, F.lit(":"))
    if ":" in pattern:
        half_day = c.rlike(r"\p{L}\z")
        out = out & (half_day if pattern.endswith(" a") else ~half_day)
    if "MMM" in pattern:
        return out & c.rlike(r"\p{L}{3}")
    for sep in "/-.":
        if sep in pattern.split(" ")[0]:
            out = out & F.contains(c, F.lit(sep))
    return out


def _parse_ntz(c: Column, pattern: str) -> Column:
    """Wall-clock parse, independent of the session time zone (no DST-gap shifts).

    ``try_to_timestamp`` screens the text (null instead of an ANSI error); the
    value itself comes from ``to_timestamp_ntz``.
    """
    return F.when(_may_have(c, pattern) & F.try_to_timestamp(c, F.lit(pattern)).isNotNull(), F.to_timestamp_ntz(c, F.lit(pattern)))


def _first_parse(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[_parse_ntz(c, p) for p in patterns])


def _iso(c: Column) -> Column:
    """Year-month-day with an optional time, fraction and offset; a time with an offset is given in UTC."""
    time = F.regexp_extract(c, ISO, 2)
    base = F.concat(F.regexp_extract(c, ISO, 1), F.when(time != "", F.concat(F.lit(" "), time)).otherwise(F.lit(" 00:00")))
    offset = F.regexp_replace(F.regexp_extract(c, ISO, 3), ":", "")
    minutes = F.when(offset.rlike("^[+-]"), F.concat(F.substring(offset, 1, 1), F.lit("1")).cast("int")
                     * (F.substring(offset, 2, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(offset, 4, 2), F.lit("")).cast("int"), F.lit(0))))
    parsed = _parse_ntz(base, "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS]")
    return F.when(c.rlike(ISO), parsed - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0))))


def _date_of(c: Column, family: list[str]) -> Column:
    c = strip(c)
    return F.coalesce(_iso(c), _first_parse(c, PLAIN_PATTERNS), _first_parse(c, family))


def parse_dates_column(df: DataFrame, name: str) -> Column:
    """P3 for one column (used by ``preprocess`` on text dates); one aggregate chooses the family, day first on ties."""
    c = strip(F.col(name))
    families = list(FAMILIES.values())
    row = df.agg(*[F.count(_first_parse(c, pats)).alias(f"d{j}") for j, pats in enumerate(families)]).first()
    return _date_of(F.col(name), families[max(range(len(families)), key=lambda j: (row[f"d{j}"], -j))])


def parse_dates(df: DataFrame) -> DataFrame:
    """P3 alone: every *text* column whose name mentions a date keyword."""
    return type_columns(df, numbers=[])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with every data column null are dropped."""
    data = [c for c in df.columns if c != "_row_id"]
    return df.dropna(how="all", subset=data)


def read_export(spark: SparkSession, path: str, min_numeric_ratio: float = 0.6, glob: str = "*.csv",
                multi_line: bool | str = True) -> DataFrame:
    """One or many exports -> one typed table with ``_row_id`` (unique; record order within a file).

    Types are decided per header group; groups are stacked by column name.
    Large files are read by many tasks, line breaks inside quoted fields or
    not.  ``multi_line="file"`` reads each file in one task by Spark's own
    multi-line parser (always done for files whose lines end in lone carriage
    returns); ``multi_line=False`` takes every line as a record.  A row of a
    file's head is all the driver holds of it.  A quote that opens a field and
    is never closed makes the rest of its file one field, as in any CSV parser.
    """
    splits = scan_splits(spark, path, glob)
    heads = _heads(splits)
    if not heads:
        raise FileNotFoundError(f"no {glob} files with records under {path}")
    groups: dict[tuple, list[str]] = {}
    for h in heads:
        groups.setdefault((h.encoding, h.header, multi_line is True and not h.cr_only), []).append(h.path)
    crossing = any(h.crossing for h in heads)
    entered = splits.select("path", "start", "length", "inside", "split")
    staged = None
    for i, ((encoding, header, by_split), files) in enumerate(groups.items()):
        if by_split:
            part = _parse_text(_split_records(spark, files, encoding, entered), header)
        else:
            part = _parsed(spark, files, encoding, header, bool(multi_line))
        part = part.withColumn("_group", F.lit(i))
        staged = part if staged is None else staged.unionByName(part, allowMissingColumns=True)
    base = f"{checkpoint_dir(spark).rstrip('/')}/staged/{uuid.uuid4().hex}"
    staged = staged.withColumn("_row_id", F.monotonically_increasing_id())
    staged.write.partitionBy("_group", "_kind").parquet(base)
    table = spark.read.schema(staged.schema).parquet(base)
    parts = []
    for i, ((_, header, by_split), files) in enumerate(groups.items()):
        own = [*[f"_c{k}" for k in range(len(header))], "_file", "_task", "_is_header", "_row_id"]
        mine = table.where(F.col("_group") == i)
        records = mine.where(F.col("_kind") == 0).select(*own)
        if by_split and crossing:
            pieces = mine.where(F.col("_kind") != 0).select("_file", "_task", "_kind", "_text", "_row_id")
            records = records.unionByName(_put_together(pieces, header).select(*own))
        named = _name_columns(_after_header(records, len(files)), list(header))
        raw = null_tokens(named, [c for c in named.columns if c != "_row_id"])
        parts.append(drop_empty_rows(type_columns(clean_ids(raw), min_numeric_ratio)))
    return _stack(parts)


def kept(loaded: DataFrame) -> DataFrame:
    """A loaded table written once, typed, in the shared folder and read back.

    For more than one question: each would parse all cells again, a date once for each column taken from it.
    """
    path = f"{checkpoint_dir(loaded.sparkSession).rstrip('/')}/typed/{uuid.uuid4().hex}"
    loaded.write.parquet(path)
    return loaded.sparkSession.read.schema(loaded.schema).parquet(path)


def _stack(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column typed differently across groups falls back to text."""
    types: dict[str, set] = {}
    for p in parts:
        for f in p.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {c for c, ts in types.items() if len(ts) > 1}
    out = None
    for p in parts:
        if mixed & set(p.columns):
            p = p.withColumns({c: F.col(c).cast("string") for c in mixed & set(p.columns)})
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def content_type_of(df: DataFrame) -> str:
    """S9 on a loaded table."""
    return detect_content_type([c.lower() for c in df.columns])


# ------------------------------------------------------------------ a messy export from posts
def _shown(style: str) -> list[Column]:
    """The posts' columns as an export shows them: ``1,234`` thousands, ``12.5k`` views, ids as ``123.0``, dates by style."""
    views = F.when(F.col("views") % 100 == 0,
                   F.concat(F.format_string("%.1f", F.col("views") / F.lit(1000.0)), F.lit("k"))) \
        .otherwise(F.col("views").cast("string"))
    when = F.col("publish_time")
    date = {"day_first": ntz_text("publish_time", "dmy"),
            "offset": F.concat(F.replace(ntz_text("publish_time", "iso"), F.lit(" "), F.lit("T")), F.lit("+0000")),
            "am_pm": F.format_string("%02d/%02d/%04d %d:%02d:%02d %s", F.dayofmonth(when), F.month(when), F.year(when),
                                     (F.hour(when) + 11) % 12 + 1, F.minute(when), F.second(when).cast("int"),
                                     F.when(F.hour(when) < 12, "AM").otherwise("PM"))}[style]
    return [F.concat(F.col("post_id").cast("string"), F.lit(".0")).alias("Post ID"), date.alias("Publish time"),
            F.col("post_type").alias("Post type"), F.col("duration_sec").cast("string").alias("Duration (sec)"),
            F.format_number(F.col("reach"), 0).alias("Reach"), F.col("impressions").cast("string").alias("Impressions"),
            views.alias("Views"),
            *[F.col(c).cast("string").alias(c.capitalize().replace("_", " ")) for c in
              ("likes", "comments", "saves", "shares", "follows", "profile_visits")]]


def write_messy_export(posts: DataFrame, path: str) -> str:
    """Write the posts table the way a platform export looks (for tests and the
    round-trip query); as many part files as the table has partitions, each with a header."""
    posts.select(*_shown("day_first")).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)
    return path


def _ragged_lines(header: list[str]):
    """CSV lines with what exports put around them: a preamble, the header, lines of too many fields, empty lines."""
    import pyarrow as pa

    schema = pa.schema([("value", pa.string())])

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": ["Account report", "", ",".join(header)]}, schema=schema)
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                fields = ["" if v is None else f'"{v}"' if "," in v else v for v in r.values()]
                lines.append(",".join(fields))
                if int(float(fields[0])) % 5 == 0:
                    lines += [",".join([*fields, ""]), "," * (len(header) - 1)]
            yield pa.RecordBatch.from_pydict({"value": lines}, schema=schema)

    return run


def write_mixed_exports(posts: DataFrame, path: str) -> str:
    """The posts table as four exports of different making, a quarter of the posts each.

    ``0``: as ``write_messy_export``.  ``1``: Latin-1, with a caption of which only
    few have an accent.  ``2``: other column order, dates with an offset, tabs
    and no-break spaces around numbers, missing-value words.  ``3``: AM / PM
    dates, a preamble, lines with an empty field too many (copies that must
    not be read) and lines of empty fields.
    """
    part = lambda i: posts.where(F.pmod("post_id", F.lit(4)) == i)
    write_messy_export(part(0), f"{path}/0")
    accent = F.when(F.col("post_id") % 41 == 0, "caf\u00e9, au lait").otherwise("plain words").alias("Caption")
    part(1).select(*_shown("day_first"), accent).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/1")
    shown = _shown("offset")
    padded = part(2).select(*shown).select(*reversed([
        F.concat(F.lit("\t"), F.col(c), F.lit("\u00a0")).alias(c) if c == "Likes"
        else F.coalesce(F.col(c), F.lit("N/A")).alias(c) if c in ("Saves", "Reach") else F.col(f"`{c}`") for c in
        posts.sparkSession.createDataFrame([], posts.schema).select(*shown).columns]))
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/2")
    rows = part(3).select(*_shown("am_pm"))
    rows.mapInArrow(_ragged_lines(rows.columns), "value string").write.text(f"{path}/3")
    return path
