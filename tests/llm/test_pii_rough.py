import pytest

from tallyweave.llm import pii_tagger as pt


@pytest.mark.parametrize("number", ["06 39 98 64 40", "+33 6 39 98 64 40", "+49 3 1 4 1 5 9 2", "+1 212 555 0123", "(212) 555-0123", "0171/2345"])
def test_prefilter_lets_every_way_of_writing_a_phone_number_pass(number):
    text = f"Please ring {number} before noon."
    assert pt.CANDIDATES[1].search(text)[0] == number
    assert pt.Batch([text]).stretches[0, "PHONE"] == [(12, 12 + len(number))]
