"""Record rejects and orphan references on hand-made rows, against brute force and against SQL."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import refs, rejects

HEADS = [(1, "a.csv", ",", "ID,Resume_str,years_experience,updated_on"), (2, "b.txt", "|", "updated_on|ID|Resume_str|Category")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (1, 1, 'abc,"x, ""y""\nz",5,2020-02-29'),
        (2, 1, 'abc,x "y" z,5,2020-01-01'),
        (3, 1, 'abc,"open,5,2020-01-01'),
        (4, 1, "abc,x,5"),
        (5, 1, "abc,x,5,2020-01-01,"),
        (6, 1, "ab,x,5,2020-01-01"),
        (7, 1, "abc,  ,5,2020-01-01"),
        (8, 1, "abc,x,61,2020-01-01"),
        (9, 1, "abc,x,,"),
        (10, 1, "abc,x,5,2021-02-29"),
        (11, 1, "abc\n,x,5,2020-01-01"),
        (12, 2, '2020-01-01|a-b_c|"p|q"|'),
        (13, 2, "|abc|x\x01a\x01b|c"),
        (14, 1, None),
        (15, 1, ""),
        (16, 9, "abc,x"),
        (17, 1, "abc,x,٧,2020-01-01"),
        (18, 1, 'abc,"",5,2020-01-01'),
        (19, 1, 'abc,"x""",60,'),
        (20, 1, 'abc,"x"y,60,'),
        (1, 1, 'abc,"x, ""y""\nz",5,2020-02-29'),
        (21, 1, "abc," + "x" * 200_000 + ",0,2020-01-01"),
        (22, 1, "abc,x," + "9" * 50 + ",2020-01-01"),
        (None, 1, "abc,x"),
        (2, 1, "abc,fine,1,"),
    ]
    raw = spark.createDataFrame(rows, "rec_id long, file_id int, rec_text string").withColumn("delim", F.lit("clash")).withColumn("names", F.lit("clash"))
    return raw, spark.createDataFrame(HEADS, "file_id int, file_name string, delim string, header_text string"), rejects.rule_table(spark)


def test_reasons(tables):
    got = sorted(((r.rec_id, r.reason) for r in rejects.errors(*tables).collect()), key=str)
    want = {2: "quoting", 3: "quoting", 4: "column_count", 5: "column_count", 6: "invalid_value", 7: "invalid_value", 8: "invalid_value", 10: "invalid_value", 11: "invalid_value", 14: "column_count", 15: "column_count", 16: "unknown_file", 17: "invalid_value", 18: "invalid_value", 20: "quoting", 22: "invalid_value", None: "column_count"}
    assert got == sorted(want.items(), key=str)


def test_valid_rows(tables):
    got = {(r.rec_id, r.Resume_str[:20]): r for r in rejects.valid_rows(*tables).collect()}
    assert {k[0] for k in got} == {1, 2, 9, 12, 13, 19, 21}
    assert got[1, 'x, "y"\nz'].years_experience == 5 and got[1, 'x, "y"\nz'].updated_on == dt.date(2020, 2, 29)
    assert got[12, "p|q"].Category is None and got[13, "x\x01a\x01b"].Category == "c"
    assert got[9, "x"].years_experience is None and got[9, "x"].updated_on is None
    assert rejects.valid_rows(*tables).where("rec_id = 1").count() == 2


def test_empty_inputs(spark, tables):
    raw, files, rules = tables
    assert rejects.errors(raw.limit(0), files, rules).count() == 0
    assert {r.reason for r in rejects.errors(raw, files.limit(0), rules).collect()} == {"unknown_file"}
    assert rejects.valid_rows(raw.limit(0), files, rules).count() == 0


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * n)


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice([str(rng.randint(0, 40)), str(65530 + rng.randint(0, 12)), "x" + str(rng.randint(0, 4)), "007", "12.0", "123456789012345678901", None, " ", "7"])
    parents = []
    for _ in range(120):
        a = rng.choice([None] + list(range(40)))
        parents.append((rng.choice(["", " ", "\t"]) + k if (k := key()) else k, day(a), day(rng.choice([None, None, rng.randint(0, 50)])), "c"))
    links = [(i, (rng.choice([" ", "", "\t"]) + k) if (k := key()) else k, day(rng.choice([None] + list(range(50)) * 2))) for i in range(900)]
    strip = lambda s: None if s is None or not s.strip(" \t") else s.strip(" \t")
    want = set()
    for i, k, t in links:
        k = strip(k)
        if k is None:
            continue
        own = [p for p in parents if strip(p[0]) == k]
        if not own:
            want.add((i, "missing"))
        elif t is not None:
            loaded = [p for p in own if p[1] is not None and p[1] <= t]
            if not any(p[2] is None or p[2] > t for p in loaded):
                want.add((i, "deleted" if loaded else "late"))
    p = spark.createDataFrame(parents, "k string, loaded_at timestamp, deleted_at timestamp, target string")
    r = spark.createDataFrame(links, "id long, key string, at timestamp").withColumn("target", F.lit("t"))
    got = refs.orphans(r, {"t": (p.drop("target"), "k")}, carry=("id",))
    assert {(x.id, x.reason) for x in got.collect()} == want


def test_orphans_of_empty_tables(spark):
    p = spark.createDataFrame([], "k string, loaded_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame([(1, "5", day(1)), (1, "5", day(1)), (2, "a", None)], "id long, key string, at timestamp").withColumn("target", F.lit("t"))
    assert sorted((x.id, x.reason) for x in refs.orphans(r, {"t": (p, "k")}, carry=("id",)).collect()) == [(1, "missing"), (1, "missing"), (2, "missing")]
    assert refs.orphans(r.limit(0), {"t": (p, "k")}, carry=("id",)).count() == 0


def test_runs_join_neighbours(spark):
    keys = spark.createDataFrame([("t", str(k)) for k in (1, 2, 3, 7, 8, 65535, 65536)], "target string, key string")
    assert sorted((r.first, r.last) for r in refs.key_runs(keys).collect()) == [(1, 3), (7, 8), (65535, 65535), (65536, 65536)]
