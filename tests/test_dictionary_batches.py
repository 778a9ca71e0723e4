import os
from datetime import datetime, timedelta, timezone

import pytest

from tallyweave.functions.instants import parse_instant
from tallyweave.operators import instant_dictionary as di
from tallyweave.operators.instant_dictionary import KEYS, InstantDictionary
from tallyweave.plans import data_quality as dq

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_later_batches_and_runs_parse_only_new_texts(spark, monkeypatch):
    monkeypatch.setattr(di, "shared_dir", lambda _: dq.Scratch(spark, "own").root)
    path, sizes = [], []
    extend = InstantDictionary.extend

    def watch(self, values, about=0):
        path.append(self.path if not path else path[0])
        self.path = path[0]
        self.__init__(spark, path[0])
        extend(self, values, about)
        sizes.append(self.read().count())

    monkeypatch.setattr(InstantDictionary, "extend", watch)
    rows = dq.p4_found(spark, SF).collect()
    assert len(sizes) == 2 and 0 < sizes[0] < sizes[1]
    known = InstantDictionary(spark, path[0]).read()
    assert known.select(*KEYS).distinct().count() == sizes[1]
    again = dq.p4_found(spark, SF).collect()
    assert sizes == [sizes[0], sizes[1], sizes[1], sizes[1]]  # the second run has nothing to parse
    assert sorted(again) == sorted(rows)
    every = {tuple(r) for r in dq.pending_values(spark, SF).filter("value is not null").select("raw_record_id", "value", "zone", "locale").collect()}
    want = {i: m for i, v, z, c in every if (m := parse_instant(v, z or "", c or "")) is not None}
    assert {r.raw_record_id for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        t = datetime.fromisoformat(r.occurred_at_utc)
        assert round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) == want[r.raw_record_id]
