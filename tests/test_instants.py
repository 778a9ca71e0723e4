from datetime import datetime, timezone

import pytest

from tallyweave.functions.instants import parse_instant
from tallyweave.operators.instant_dictionary import InstantDictionary
from tallyweave.sources.tables import Scratch

B, NY, PAR, IN, TYO = ("Europe/Berlin", "de-DE"), ("America/New_York", "en-US"), ("Europe/Paris", "fr-FR"), ("Asia/Kolkata", "en-IN"), ("Asia/Tokyo", "ja-JP")


@pytest.mark.parametrize(
    "text, where, want",
    [
        ("2025-09-01T02:27:20+02:00", B, "2025-09-01T00:27:20"), ("2025-09-01t09:46:24.000z", B, "2025-09-01T09:46:24"), ("20250901T114435+0200", B, "2025-09-01T09:44:35"),
        ("2025-09-01 09:44:29 CEST", B, "2025-09-01T07:44:29"), ("2025-09-03 10:36:25 UTC-5", NY, "2025-09-03T15:36:25"), ("2025-09-04 12:07:53 UTC+5:30", IN, "2025-09-04T06:37:53"),
        ("2025-09-01 06:57:40 −07:00", NY, "2025-09-01T13:57:40"), ("Sun, 01 Mar 2026 13:29:33 +0000", B, "2026-03-01T13:29:33"), ("Sun, 01 Mar 2026 17:09:09 GMT", NY, "2026-03-01T17:09:09"),
        ("1756712901", B, "2025-09-01T07:48:21"), ("1756714257000", B, "2025-09-01T08:10:57"), ("1756742011095000", B, "2025-09-01T15:53:31.095000"), ("20250901083711", TYO, "2025-08-31T23:37:11"),
        ("01/02/2026 03:08 PM", NY, "2026-01-02T20:08:00"), ("1/2/2026", NY, "2026-01-02T05:00:00"), ("01/02/2026 15:08", PAR, "2026-02-01T14:08:00"), ("2.9.25 14:37:00", B, "2025-09-02T12:37:00"),
        ("01-09-2025 12:29 a.m.", IN, "2025-08-31T18:59:00"), ("2025/09/15 22:19", TYO, "2025-09-15T13:19:00"), ("1er septembre 2025 à 15h38", PAR, "2025-09-01T13:38:00"),
        ("11. März 2026 15:35:10 Uhr", B, "2026-03-11T14:35:10"), ("11 de agosto de 2026 05:08:54", ("America/Sao_Paulo", "pt-BR"), "2026-08-11T08:08:54"), ("Aug 10, 2026 4:33:31 AM", NY, "2026-08-10T08:33:31"),
        ("01-OCT-2025, 02:55:27", TYO, "2025-09-30T17:55:27"), ("\t2025-09-01 12:58:17.376000355\n", B, "2025-09-01T10:58:17.376000"), ("2025-09-01T05:43:34+05:30[Asia/Kolkata]", IN, "2025-09-01T00:13:34"),
        ("2025-10-26 02:30:00", B, "2025-10-26T00:30:00"), ("2025-09-01T24:00:00Z", B, "2025-09-02T00:00:00"),
    ],
)
def test_readable(text, where, want):
    assert parse_instant(text, *where) == round(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize("text", ["", " ", "--", "n/a", "pending", "yesterday 14:00", "14:08:00", "2025-09-??", "2026-04-31", "2026-13-05 08:00:00", "0000-00-00 00:00:00", "2026-06-12T25:10:00Z", "2026-03-29 02:15:35", "31/02/2026 10:00", "13:00 PM", "Mon, 02 Sep 2025 01:00:00 GMT", None])
def test_denotes_nothing(text):
    assert parse_instant(text, *B) is None


def test_dictionary_grows_and_spreads(spark):
    rows = spark.createDataFrame([(1, "2025-09-01 00:00", "UTC", "en-GB", "x"), (2, "2025-09-01 00:00", "UTC", "en-GB", "y"), (3, "pending", "UTC", None, "z"), (4, None, "UTC", None, "z"), (5, "2025-09-01T00:00:00Z", None, None, None)], "id int, value string, zone string, locale string, micros string")
    d = InstantDictionary(spark, Scratch(spark, "test").root + "/d")
    got = {r["id"]: r["micros"] for r in d.normalise(rows, "id", "value", "zone", "locale").collect()}
    assert set(got) == {1, 2, 5} and len(set(got.values())) == 1
    size = d.read().count()
    assert d.normalise(rows, "id", "value", "zone", "locale").count() == 3 and d.read().count() == size == 2
    assert d.normalise(rows.limit(0), "id", "value", "zone", "locale").count() == 0
