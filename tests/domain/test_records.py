"""Small columns, parameters, exports and empty audits by hand."""

import csv
import glob
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pyrelake.operators import records


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_names(spark):
    got = one(spark, records.display_name(F.lit("national_park"), F.lit("Lanín")), records.display_name(F.lit("other"), F.lit("X")), records.jurisdiction(F.lit(" Federal ")), records.jurisdiction(F.lit("?")))
    assert got == ("Parque Nacional Lanín", "other X", "national", None)


def test_date_list(spark):
    given = F.array(*map(F.lit, ("2024-03-01", "2024-03-01", "2025-01-01")))
    base = F.lit("2024-01-31").cast("date")
    got = one(spark, records.date_list(given, base, [1, 2, 2, -1], 4, "2024-12-31"), records.date_list(F.lit(None).cast("array<string>"), base, [0], 2), records.date_list(given, F.lit(None).cast("date"), [1], 1))
    assert got == (["2024-03-01", "2024-02-29", "2024-03-31", "2023-12-31"], ["2024-01-31"], ["2024-03-01"])


@pytest.mark.parametrize(("before", "after", "want"), [(0, 0, (0, 1)), (-3, 2, (0, 2)), (9, 9, (6, 6)), (2, 20, (2, 10)), (5, 8, (5, 7))])
def test_normal_counts(spark, before, after, want):
    assert tuple(one(spark, records.normal_counts(F.lit(before), F.lit(after), 6, 10, 12))[0]) == want


def test_boxes(spark):
    text = ["-60,-30,-59,-29", " -60 , -30,, -59,-29 ", "1,2,3", "a,0,1,1", "2,0,1,1", "-181,0,1,1", "0,-91,1,1", None]
    df = spark.createDataFrame([(t,) for t in text], "t string").select(records.parsed_box(F.col("t")).alias("b"))
    assert [r["b"] is not None for r in df.collect()] == [True, True] + [False] * 6
    whole = '{"west": "1", "south": 2, "east": 3, "north": 4}'
    df = spark.createDataFrame([(whole, 5.0, 6.0), ('{"west": 1}', 5.0, 6.0), ("no json", None, 6.0), (None, 5.0, None)], "a string, lat double, lon double")
    got = [r[0] and tuple(r[0]) for r in df.select(records.box_or_point(F.col("a"), F.col("lat"), F.col("lon"), 0.5)).collect()]
    assert got == [(1.0, 2.0, 3.0, 4.0), (5.5, 4.5, 6.5, 5.5), None, None]


def test_history(spark):
    got = one(spark, records.with_history(F.lit("7"), F.lit(None).cast("string"), F.lit("t1")), records.with_history(F.lit("8"), F.lit('[{"at": "t1", "value": "7"}]'), F.lit("t2")))
    assert [json.loads(h) for h in got] == [[{"at": "t1", "value": "7"}], [{"at": "t1", "value": "7"}, {"at": "t2", "value": "8"}]]


def test_parameters(spark):
    rows = spark.createDataFrame([("a", '{"value": 5}'), ("b", '{"value": "x"}'), ("c", "broken")], "key string, value string")
    assert records.parameters(rows, {"a": "1", "b": "2", "c": "3", "d": "4"}) == {"a": "5", "b": "x", "c": "3", "d": "4"}
    with pytest.raises(KeyError):
        records.parameters(rows, {"a": "1", "d": "4"}, strict=True)


def test_export_logs(spark, tmp_path):
    rows = [(k, "s1" if k % 2 else "s2", date(2024, 1, k), "day", f"L{k}", k, datetime(2024, 1, k)) for k in range(1, 8)]
    logs = spark.createDataFrame(rows, "id long, shelter_id string, visit_date date, registration_type string, group_leader_name string, total_people int, created_at timestamp_ntz")
    records.export_logs(logs.repartition(3), f"{tmp_path}/out", "2024-01-02", "2024-01-06", "s1")
    got = [r for f in sorted(glob.glob(f"{tmp_path}/out/*.csv")) for r in csv.DictReader(open(f))]
    assert [r["id"] for r in got] == ["5", "3"]
    assert list(got[0]) == ["id", "shelter_id", "visit_date", "registration_type", "group_leader_name", "total_people", "created_at"]


def test_saved_filters(spark):
    rows = [(1, False, None, 3), (2, False, 5, 1), (3, True, None, 0), (4, False, 9, 0), (5, False, None, 4)]
    df = spark.createDataFrame(rows, "id long, is_default boolean, last_used_at int, created_at int")
    assert [r["id"] for r in records.saved_filters(df).collect()] == [3, 4, 2, 5, 1]


def test_empty_audit(spark):
    rows = spark.createDataFrame([], "id long, prohibition_until date")
    r = records.audit_verdict(rows, "2024-01-01").first()
    assert (r["n_events"], r["is_prohibited"], r["years_remaining"], r["severity"]) == (0, False, 0, "none")
    episodes = spark.createDataFrame([], "episode_id string, province string, area_id long, lat double, lon double, start_date date, end_date date")
    areas = spark.createDataFrame([], "area_id long, official_name string")
    assert records.audit_search(episodes, areas, "nowhere").collect() == []
    assert records.audit_search(episodes, areas, "nowhere", point=(0.0, 0.0)).collect() == []
