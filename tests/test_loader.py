import datetime as dt
import random

from pyspark.sql import functions as F

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from csv_cases import write_cases
from postlytics.operators.roles import dedupe_names, clean_names, resolve_roles
from postlytics.sources.csv_export import content_type_of, flow_states, read_export, scan_splits


@pytest.fixture(scope="module")
def cases(tmp_path_factory):
    return write_cases(str(tmp_path_factory.mktemp("exports")))


def rows(df):
    return [tuple(r) for r in df.orderBy("_row_id").drop("_row_id").collect()]


@pytest.mark.parametrize("name", ["preamble_padded.csv", "preamble_ragged.csv"])
def test_header_after_preamble(spark, cases, name):
    df = read_export(spark, cases[name])
    assert [c for c in df.columns if c != "_row_id"] == ["post_id", "reach", "likes"]
    assert rows(df) == [("1", 100.0, 5.0), ("2", 200.0, 6.0), ("3", 300.0, 7.0)]


def test_bom_and_latin1(spark, cases):
    assert read_export(spark, cases["bom.csv"]).columns[0] == "post_id"
    assert "café_likes" in read_export(spark, cases["latin1.csv"]).columns


def test_bad_lines(spark, cases):
    assert rows(read_export(spark, cases["bad_lines.csv"])) == [
        ("1", 100.0, 5.0), ("3", 300.0, None), ("4", 400.0, 8.0)]


def test_duplicate_names(spark, cases):
    assert read_export(spark, cases["dup_names.csv"]).columns[:4] == ["post_id", "likes", "likes_1", "likes_2"]
    assert dedupe_names(clean_names(["a", "a", "a_1"])) == ["a", "a_1", "a_1_1"]


def test_suffixes(spark, cases):
    vals = [r[1] for r in rows(read_export(spark, cases["suffixes.csv"]))]
    assert vals == [1200.0, None, 2000000.0, 1234.0, 5.0, 7.0]


def test_numeric_ratio_threshold(spark, cases):
    assert dict(read_export(spark, cases["ratio_059.csv"]).dtypes)["v"] == "string"
    assert dict(read_export(spark, cases["ratio_060.csv"]).dtypes)["v"] == "double"


def test_dates_day_first_and_iso(spark, cases):
    d = [r[1] for r in rows(read_export(spark, cases["dates.csv"]))]
    assert d == [dt.datetime(2024, 7, 5, 10, 30), dt.datetime(2024, 7, 15, 8, 0), None]
    iso = [r[1] for r in rows(read_export(spark, cases["iso_dates.csv"]))]
    assert iso == [dt.datetime(2024, 7, 5), dt.datetime(2024, 7, 15)]


def test_spanish_roles(spark, cases):
    r = resolve_roles(read_export(spark, cases["spanish.csv"]).columns)
    assert (r.date, r.reach, r.comments, r.saves, r.shares) == (
        "fecha", "alcance", "comentarios", "guardados", "compartidos")


@pytest.mark.parametrize("name,label", [("reels.csv", "reels"), ("videos.csv", "videos"),
                                        ("stories.csv", "stories"), ("posts.csv", "posts"),
                                        ("unknown.csv", "unknown")])
def test_content_type(spark, cases, name, label):
    assert content_type_of(read_export(spark, cases[name])) == label


def test_empty_rows_and_multiline(spark, cases):
    assert rows(read_export(spark, cases["empty_rows.csv"])) == [("a", "1"), ("b", "2")]
    ml = rows(read_export(spark, cases["multiline.csv"]))
    assert ml[0][1] == "line one\nline two" and len(ml) == 2


def test_many_files_mixed_headers(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "a.csv").write_bytes(b"Report,,\nPost ID,Reach,Likes\n1,100,5\n2,200,6\n")
    (d / "b.csv").write_bytes(b"Post ID,Reach,Likes\n3,300,7\n")
    (d / "c.csv").write_bytes(b"Post ID,Reach,Saves\n4,400,1\n")
    df = read_export(spark, str(d))
    got = sorted((r["post_id"], r["reach"], r["likes"], r["saves"]) for r in df.collect())
    assert got == [("1", 100.0, 5.0, None), ("2", 200.0, 6.0, None), ("3", 300.0, 7.0, None),
                   ("4", 400.0, None, 1.0)]


def test_split_files_keep_every_row(spark, tmp_path):
    """Without multiLine, a large file is read by many tasks; preamble and header
    are dropped only in the first one, every data row survives once."""
    d = tmp_path / "big"
    d.mkdir()
    lines = ["Report,,", "Post ID,Reach,Likes"] + [f"{i},{i * 10},{i % 7}" for i in range(200000)]
    (d / "big.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        df = read_export(spark, str(d), multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        agg = df.agg(F.count("*"), F.countDistinct("post_id"), F.sum("reach")).first()
        assert agg[0] == agg[1] == 200000 and agg[2] == sum(i * 10 for i in range(200000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_month_first_dates_when_they_parse_best(spark, tmp_path):
    d = tmp_path / "mdy"
    d.mkdir()
    (d / "mdy.csv").write_bytes(b"post_id,date\n1,07/15/2024\n2,12/31/2024\n3,01/02/2024\n")
    got = [r["date"] for r in read_export(spark, str(d)).orderBy("_row_id").collect()]
    assert got == [dt.datetime(2024, 7, 15), dt.datetime(2024, 12, 31), dt.datetime(2024, 1, 2)]


def test_latest_file(spark, tmp_path):
    import os
    import time

    from postlytics.sources.csv_export import latest_file

    d = tmp_path / "many"
    d.mkdir()
    (d / "old.csv").write_bytes(b"a\n1\n")
    (d / "new.csv").write_bytes(b"a\n2\n")
    os.utime(d / "old.csv", (time.time() - 1000, time.time() - 1000))
    assert latest_file(spark, str(d)).first()["path"].endswith("new.csv")
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        latest_file(spark, str(empty))


def test_encoding_is_decided_by_the_whole_file(spark, cases):
    for name in ("late_latin1.csv", "late_utf8.csv"):
        got = {r["post_id"]: r["caption"] for r in read_export(spark, cases[name]).collect()}
        assert len(got) == 301 and got["300"] == "caf\xe9" and got["0"] == "plain"


def test_an_empty_extra_field_makes_a_row_too_long(spark, cases):
    got = read_export(spark, cases["empty_extra.csv"])
    assert sorted(r["post_id"] for r in got.collect()) == ["1", "3", "4", "6"]


def test_any_white_space_is_stripped(spark, cases):
    assert [r[1] for r in rows(read_export(spark, cases["spaces.csv"]))] == [100.0, 200.0, 300.0, 400.0]


def test_date_layouts_of_exports(spark, cases):
    got = {r["post_id"]: r["date"] for r in read_export(spark, cases["all_dates.csv"]).collect()}
    day = dt.datetime(2024, 7, 5, 10, 30)
    assert got["1"] == got["2"] == got["7"] == day
    assert got["3"] == day.replace(microsecond=123000) and got["6"] == day.replace(hour=8)
    assert got["4"] == dt.datetime(2024, 7, 15, 22, 30) and got["5"] == dt.datetime(2024, 7, 5)
    assert got["8"] == dt.datetime(2024, 7, 5, 7, 5) and got["9"] is None


def test_row_ids_are_unique_over_mixed_headers(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"a{i}.csv").write_text("post_id,reach\n" + "".join(f"a{i}{k},{k}\n" for k in range(7)))
        (tmp_path / f"b{i}.csv").write_text("Report\nreach,post_id,likes\n" + "".join(f"{k},b{i}{k},1\n" for k in range(7)))
    got = read_export(spark, str(tmp_path))
    assert got.count() == 70 == got.select("_row_id").distinct().count() == got.select("post_id").distinct().count()
    assert sorted(got.columns) == ["_row_id", "likes", "post_id", "reach"]


def test_no_job_for_each_file(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"a{i}.csv").write_text("post_id,reach\n" + "".join(f"a{i}{k},{k}\n" for k in range(3)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("loader", "loader")
    try:
        assert read_export(spark, str(tmp_path)).columns
        assert len(tracker.getJobIdsForGroup("loader")) < 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_missing_value_words_and_empty_rows(spark):
    from postlytics.sources.csv_export import NA_TOKENS, drop_empty_rows, null_tokens

    words = [*NA_TOKENS, "NONE", "0", "none", " "]
    df = spark.createDataFrame([(i, w, None) for i, w in enumerate(words)], "_row_id long, a string, b string")
    got = null_tokens(df, ["a", "b"])
    assert [r["a"] for r in got.orderBy("_row_id").collect()] == [None] * len(NA_TOKENS) + ["NONE", "0", "none", " "]
    assert drop_empty_rows(got).count() == 4


def test_a_column_plays_one_role():
    from postlytics.operators.roles import ambiguous_roles

    r = resolve_roles(["date", "length", "video_views", "likes", "post_likes", "media_type", "type"])
    assert (r.date, r.duration, r.views, r.likes, r.type) == ("date", "length", "video_views", "likes", "media_type")
    assert ambiguous_roles(["likes", "post_likes"]) == {"likes": ["likes", "post_likes"]}
    r = resolve_roles(["profile_activity", "fecha", "upload_time"])
    assert r.follows == "profile_activity" and r.date == "fecha"
    assert resolve_roles([]).date is None


def test_sinks_write_what_they_show(spark, pre_small, tmp_path):
    from postlytics.operators import eda
    from postlytics.sources import sinks

    sinks.write_summary_csv(pre_small, str(tmp_path / "summary"))
    sinks.write_top_posts_csv(pre_small, str(tmp_path / "top"))
    sinks.write_json(pre_small.df.limit(20), str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == eda.describe_numeric(pre_small).count()
    assert spark.read.option("header", True).csv(str(tmp_path / "top")).count() == 10
    assert spark.read.json(str(tmp_path / "json")).count() == 20


# ------------------------------------------------------------------ records with line breaks over many splits
@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _wild_export(seed, rows, ends):
    """Captions with line breaks, doubled quotes, commas, quotes inside plain fields and behind closing quotes, some over several splits."""
    rng = random.Random(seed)
    out = ["post_id,caption,likes"]
    for i in range(rows):
        kind = rng.randrange(9)
        long = " ".join(rng.choice(["sun", "café", "\n", "a,b", '""', "sea\n\nside"]) for _ in range(rng.choice([2, 5, 60])))
        caption = [f'"{long}"', "plain", 'the 5" lens', f'"{long}" after', "", '""', '"one\ntwo"', '"a ""b"" c"', '"x"y"z'][kind]
        out.append(f"{i},{caption},{i % 7}" + (",extra" if rng.random() < 0.03 else ""))
        if rng.random() < 0.05:
            out.append("")
    return ends.join(out) + rng.choice(["", ends])


@pytest.mark.parametrize("seed,encoding,ends", [(1, "utf-8", "\n"), (2, "utf-8", "\r\n"), (3, "latin-1", "\n")])
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, seed, encoding, ends):
    (tmp_path / "a.csv").write_bytes(_wild_export(seed, 120, ends).encode(encoding))
    (tmp_path / "b.csv").write_bytes(_wild_export(seed + 50, 30, ends).encode(encoding))
    entered = scan_splits(spark, str(tmp_path))
    assert entered.count() > 30 and entered.where("inside").count() > 5
    by_split = read_export(spark, str(tmp_path))
    in_one = read_export(spark, str(tmp_path), multi_line="file")
    assert by_split.dtypes == in_one.dtypes
    assert sorted(map(repr, rows(by_split))) == sorted(map(repr, rows(in_one)))


def test_split_ids_follow_the_file(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b"post_id,caption\n" + b"".join(b'%d,"a\n%s"\n' % (i, b"b" * (i * 7 % 300)) for i in range(60)))
    assert [int(r[0]) for r in rows(read_export(spark, str(tmp_path)))] == list(range(60))


def test_splits_are_read_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b"post_id,caption\n" + b"".join(b'%d,"a\nb"\n' % i for i in range(200)))
    splits = scan_splits(spark, str(tmp_path))
    assert splits.count() == splits.select("start").distinct().count() > 10


def test_carriage_returns_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'post_id,caption,likes\r1,"x, y",5\r2,z,6\r')
    assert rows(read_export(spark, str(tmp_path))) == [("1", "x, y", 5.0), ("2", "z", 6.0)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=12), st.booleans())
def test_flow_states(flows, entry):
    state, want = entry, []
    for opens, stays in flows:
        state = stays if state else opens
        want.append(int(state))
    got = flow_states(np.array([f[0] for f in flows]), np.array([f[1] for f in flows]), int(entry))
    assert got.tolist() == want


def test_cells_are_parsed_once(spark, tmp_path):
    """What is asked of a kept table reads typed columns; no text is parsed again."""
    (tmp_path / "a.csv").write_text("Post ID,Publish time,Likes\n1,14/03/2024 10:05,5\n2,15/03/2024 23:59,7\n")
    from postlytics.sources.csv_export import kept

    df = kept(read_export(spark, str(tmp_path)))
    plan = df.select(F.hour("publish_time"), F.month("publish_time"), "likes")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "gettimestamp" not in plan.lower()
    assert [r[0] for r in df.select(F.hour("publish_time")).orderBy("publish_time").collect()] == [10, 23]


def test_screened_parses_equal_plain_ones(spark):
    """The screen before a parse turns no text away that the parser reads."""
    from postlytics.sources.csv_export import FAMILIES, PLAIN_PATTERNS, _may_have

    days = ["3/4/2024", "13/12/2024", "31-1-2024", "1.2.2024", "Jan 5, 2024", "SEPT 5, 2024", "may 05, 2024", "March 7, 2024", "7 mar 2024",
            "07 September 2024", "7 juillet 2024", "5/6/24", "2024/05/06", "", "Mar. 7, 2024"]
    clocks = ["", " 9:05", " 09:05:30", " 23:59", " 9:05 AM", " 11:05:30 pm", " 12:00 p.m.", " 9:05 a", ":", " 9.05", "  9:05", " 13:00 PM"]
    texts = spark.createDataFrame([(d + c,) for d in days for c in clocks], "c string")
    patterns = [*PLAIN_PATTERNS, *(p for f in FAMILIES.values() for p in f)]
    c = F.col("c")
    read = texts.select("c", *[F.try_to_timestamp(c, F.lit(p)).isNotNull().alias(f"r{i}") for i, p in enumerate(patterns)],
                        *[_may_have(c, p).alias(f"m{i}") for i, p in enumerate(patterns)]).collect()
    lost = [(r["c"], p) for r in read for i, p in enumerate(patterns) if r[f"r{i}"] and not r[f"m{i}"]]
    assert not lost and sum(r[f"r{i}"] for r in read for i in range(len(patterns))) > 40
    assert sum(r[f"m{i}"] for r in read for i in range(len(patterns))) < 0.5 * len(read) * len(patterns)


def test_loaded_queries_ask_a_kept_table(spark):
    from conftest import SF_SMALL
    from postlytics.plans.registry import queries

    plan = queries()["read_export_monthly_trend"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "gettimestamp" not in plan and "regexp_replace" not in plan
