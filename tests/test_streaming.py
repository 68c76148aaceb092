import datetime as dt

from almanac.streaming import rollup


def test_days_close_as_files_arrive(spark, tmp_path):
    arriving, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()

    def arrive(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines))
        rollup.append_available(rollup.daily_totals(rollup.clean_stream(rollup.raw_stream(spark, arriving))), target, progress)
        return sorted((r.series_id, r.date, r.value) for r in spark.read.parquet(target).collect())

    first = arrive(
        "1.csv", "series,Time,Pr", "a,2020-01-01 06:00:00,1.5", "a,2020-01-01 18:00:00,2.5", "b,2020-01-01 18:00:00,n/a",
        "a,2020-01-02 00:00:00,4.0", "a,2020-01-04 12:00:00,8.0",
    )
    assert first == [("a", dt.date(2020, 1, 1), 4.0), ("a", dt.date(2020, 1, 2), 4.0)]
    second = arrive("2.csv", "a,2020-01-04 13:00:00,1.0", "b,2020-01-07 00:00:00,5.0")
    assert second == [*first, ("a", dt.date(2020, 1, 4), 9.0)]
