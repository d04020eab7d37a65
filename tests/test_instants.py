import pytest

from corpusloom.operators.instants import changed_values, dictionary, extend_dictionary, normalise, parse_day, parse_instant
from corpusloom.runtime import scratch_path


@pytest.mark.parametrize(
    "raw, month_first, day",
    [
        ("2015-04-08", False, "2015-04-08"), ("  2010-03-29\t", False, "2010-03-29"), ("07/05/2012", False, "2012-05-07"), ("11/29/2015", True, "2015-11-29"), ("11/29/2015", False, None),
        ("4.6.2022", False, "2022-06-04"), ("20110729", False, "2011-07-29"), ("15/12/07", False, "2007-12-15"), ("15/12/50", False, "1950-12-15"), ("04-fev-2009", False, "2009-02-04"),
        ("16 MAI 2003", False, "2003-05-16"), ("1º de FEVEREIRO de 2019", False, "2019-02-01"), ("18 de MARÇO de 2010", False, "2010-03-18"), ("1998-04-10T23:30:00-03:00", False, "1998-04-10"),
        ("2006-04-16T00:00:00", False, "2006-04-16"), ("29/02/2023", False, None), ("2021", False, None), ("mar/2019", False, None), ("1T2022", False, None), ("a definir", False, None), ("", False, None), ("--", False, None),
        ("99999999", False, None), ("31 de novembro de 2020", False, None), ("2007-10-14T12:00:00.000+00:00", False, "2007-10-14"),
    ],
)
def test_days(raw, month_first, day):
    assert parse_day(raw, month_first) == day


SP, NY, LX = "America/Sao_Paulo", "America/New_York", "Europe/Lisbon"


@pytest.mark.parametrize(
    "raw, zone, month_first, instant",
    [
        ("2018-03-27T23:22:55Z", NY, True, "2018-03-27T23:22:55Z"), ("2022-11-21T11:27:16.521929+00:00", SP, False, "2022-11-21T11:27:16Z"), ("20160221T045439Z", SP, False, "2016-02-21T04:54:39Z"),
        ("2023-08-13 05:07:08 -0300", SP, False, "2023-08-13T08:07:08Z"), ("03/10/2023 às 21:39:12", "UTC", False, "2023-10-03T21:39:12Z"), ("06/21/2019 às 11:54:25", NY, True, "2019-06-21T15:54:25Z"),
        ("1490192853", SP, False, "2017-03-22T14:27:33Z"), ("1482471585303", SP, False, "2016-12-23T05:39:45Z"), ("1565918079471732", SP, False, "2019-08-16T01:14:39Z"),
        ("2016-07-26 17:02:44 AMT", "America/Manaus", False, "2016-07-26T21:02:44Z"), ("2024-06-12 12:47:20 GMT", SP, False, "2024-06-12T12:47:20Z"), ("Thu, 04 Jun 2020 14:15:04 -0300", SP, False, "2020-06-04T17:15:04Z"),
        ("26 de março de 2025, 20h55", SP, False, "2025-03-26T23:55:00Z"), ("17/02/2018 23:13", SP, False, "2018-02-18T01:13:00Z"), ("2021-06-08T04:47:06,744", "UTC", False, "2021-06-08T04:47:06Z"),
        # twice: the first; skipped: the offset before the change
        ("2018-02-17 23:30:00", SP, False, "2018-02-18T01:30:00Z"), ("2018-11-04 00:30:00", SP, False, "2018-11-04T03:30:00Z"), ("2019-11-03 01:30:00", NY, False, "2019-11-03T05:30:00Z"),
        ("2019-03-10 02:30:00", NY, False, "2019-03-10T07:30:00Z"), ("2020-10-25 01:30:00", LX, False, "2020-10-25T00:30:00Z"),
        ("25:61", SP, False, None), ("n/d", SP, False, None), ("desconhecido", SP, False, None), ("2020-01-01", SP, False, None), ("2020-01-01 10:00 XYZ", SP, False, None), ("2024-07-02 10:00 Europe/Lisbon", SP, False, "2024-07-02T09:00:00Z"), ("2024-01-02T10:00:00[America/New_York]", SP, False, "2024-01-02T15:00:00Z"), ("2024-01-02T10:00:00+01:00[Europe/Paris]", SP, False, "2024-01-02T09:00:00Z"), ("2024-01-02 10:00 No/Where", SP, False, None), ("", None, False, None),
    ],
)
def test_instants(raw, zone, month_first, instant):
    assert parse_instant(raw, zone, month_first) == instant


def test_rows_and_incremental_dictionary(spark):
    docs = spark.createDataFrame([("a", "s", "01/02/2020", None, "2020-01-01 00:00:00"), ("a", "s", "01/02/2020", None, "2020-01-01 00:00:00"), ("b", "u", "01/02/2020", "2020-05-05", ""), ("c", None, None, "x", "1490192853"), (None, "zz", "02/01/2020", None, None)],
                                 "doc_id string, source string, effective_date string, expiry_date string, scraped_at string")
    registry = spark.createDataFrame([("s", SP, "dmy"), ("u", NY, "mdy"), ("zz", "no/zone", None)], "source string, tz_name string, date_order string")
    path = scratch_path(spark, "dict")
    out = normalise(docs, registry, ["effective_date", "expiry_date"], ["scraped_at"], path)
    assert {tuple(r) for r in changed_values(out).collect()} == {
        ("a", "effective_date", "2020-02-01"), ("a", "scraped_at", "2020-01-01T03:00:00Z"), ("b", "effective_date", "2020-01-02"), ("c", "scraped_at", "2017-03-22T14:27:33Z"), (None, "effective_date", "2020-01-02")}
    n = dictionary(spark, path).count()
    again = normalise(docs, registry, ["effective_date", "expiry_date"], ["scraped_at"], path)
    assert dictionary(spark, path).count() == n and again.count() == out.count()
    extend_dictionary(spark, path, spark.createDataFrame([("day", "3.4.2021", "", False), ("day", "01/02/2020", "", False)], "kind string, raw string, zone string, month_first boolean"))
    assert dictionary(spark, path).count() == n + 1
    # a run at the same time that parsed the same values, and one that didn't end
    spark.read.parquet(path + "/*").limit(3).write.parquet(f"{path}/other")
    spark.read.parquet(path + "/*").limit(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/broken")
    assert dictionary(spark, path).count() == n + 1
    assert normalise(docs, registry, ["effective_date", "expiry_date"], ["scraped_at"], path).count() == out.count()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, source string, effective_date string, expiry_date string, scraped_at string")
    registry = spark.createDataFrame([], "source string, tz_name string, date_order string")
    assert normalise(docs, registry, ["effective_date"], ["scraped_at"]).count() == 0
