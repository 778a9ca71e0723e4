import pytest

from tallyweave.llm import pii_tagger as pt
from tallyweave.llm.pii import find_pii, redact_pii
from tallyweave.llm.pii_examples import labelled_rows, unmark

ROWS = 6000


def test_marks():
    assert unmark("a ‹NAME:B C› d") == ("a B C d", [("NAME", 2, 5)])
    assert len(labelled_rows(50, 3)) == 50 and labelled_rows(20) == labelled_rows(20)


def test_held_out_accuracy():
    w = pt.default_weights(ROWS)
    texts, gold = zip(*map(unmark, labelled_rows(400, 77)))
    found = pt.find_spans(w, list(texts))
    for kind in pt.TYPES:
        a = {(d, *s) for d, x in enumerate(gold) for s in x if s[0] == kind}
        b = {(d, *s) for d, x in enumerate(found) for s in x if s[0] == kind}
        assert len(a & b) > 0.86 * len(a) and len(a & b) > 0.88 * len(b), kind


@pytest.fixture(scope="module")
def docs(spark):
    text = "Granted by Svetlana Volkov on 2026-01-15, then read by Mr. Langley.\nHer line is +44 20 7946 0123. Write to desk [at] bluebank [dot] example or <a.b@x.test>. The papers show SSN 212-33-4567. They moved to 12b N. Lavender Road, Apt 3, Bristol."
    rows = [(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, " \n ", "c"), (5, text * 40, "c"), (6, "Banco Castillo shipped 7 boxes @ 9.99 each to Bristol.", "c"), (1, text, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, pii_type string"), text


def test_found(spark, docs):
    df, text = docs
    rows = find_pii(spark, df, rows=ROWS).collect()
    got = {(r.pii_type, r.pii_text) for r in rows if r.doc_id == 1}
    assert got == {("NAME", "Svetlana Volkov"), ("NAME", "Langley"), ("PHONE", "+44 20 7946 0123"), ("EMAIL", "desk [at] bluebank [dot] example"), ("EMAIL", "a.b@x.test"), ("ID_NUMBER", "212-33-4567"), ("ADDRESS", "12b N. Lavender Road")}
    assert {r.doc_id for r in rows} == {1, 5} and all(r.pii_text in text for r in rows if r.doc_id == 1)
    assert find_pii(spark, df.limit(0), rows=ROWS).count() == 0


def test_redacted(spark, docs):
    df, _ = docs
    rows = {r.doc_id: r for r in redact_pii(spark, df, rows=ROWS).collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[4].text == " \n " and rows[6].n_replaced == 0
    assert rows[1].text == "Granted by [NAME] on 2026-01-15, then read by Mr. [NAME].\nHer line is [PHONE]. Write to [EMAIL] or <[EMAIL]>. The papers show SSN [ID_NUMBER]. They moved to [ADDRESS], Apt 3, Bristol."
