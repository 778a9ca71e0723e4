import os

import pytest
from pyspark.sql import functions as F

from tallyweave.plans import data_quality as dq

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_fates_come_from_stored_partials_and_closed_periods_are_refused(spark, monkeypatch):
    kept = {}
    put = dq.Scratch.put

    def keep(self, df, name="t"):
        kept[name] = put(self, df, name)
        return kept[name]

    monkeypatch.setattr(dq.Scratch, "put", keep)
    rows = dq.p2_found(spark, SF).collect()
    n = lambda df: df.agg(F.sum("n")).first()[0]
    of = lambda f: sum(r.fate == f for r in rows)
    assert n(kept["refused"]) == of("dropped") > 0 and n(kept["store"].filter("fate = 'late'")) == of("late") > 0
    assert n(kept["store"]) + n(kept["refused"]) == dq._p2_events(spark, SF).filter("fate is not null").count()
