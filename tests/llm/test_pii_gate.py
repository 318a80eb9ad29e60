"""The gate before the transducer never changes what is found."""

import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from merrow.llm.pii import added_spans, all_spans, disguised, folded, identifiers, masked, rewritten

BEYOND = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
FOLDS = [c for c in BEYOND if folded(c)[0] != c]
ZEROS = [c for c in BEYOND if unicodedata.decimal(c, None) == 0]


def ungated(text):
    base = identifiers(text)
    return base, added_spans(text, base)


def test_every_character_that_folds_opens_the_gate():
    assert len(FOLDS) > 1000 and [c for c in FOLDS if not disguised(c)] == []


def test_plus_before_a_bracket_opens_the_gate():
    assert disguised("call Plus (415) 555-2671") and rewritten("call Plus (415) 555-2671")[0] == "call +(415) 555-2671"


@pytest.mark.parametrize("text", ["call plus 14155552671", "call Plus 1 (415) 555-2671 now", "call\tplus\t14155552671"])
def test_plus_before_a_digit(text):
    assert [s[0] for s in all_spans(text)[1]] == ["phone"] and "[PHONE]" in masked(text)


def test_digits_of_every_script():
    for zero in ZEROS:
        number = "".join(chr(ord(zero) + int(d)) for d in "14155552671")
        text = f"call +{number} now"
        assert all_spans(text)[1] == [("phone", 5, 17)], hex(ord(zero))
        assert masked(text) == "call [PHONE] now"


PARTS = ["plus ", "PLUS\t", "plus(", " dot ", " at ", "(at)", "[ dot ]", "<.>", "{@}", "one", "Six ", "ſix ", "nine-", "14155552671", "(415) 555-2671", "10", "0", ".", "@", "+", "a", "jo", " ", "\n", "é", "’", "—", "²", "ª", "​", "\xa0", " ", "๑๒๓", "১", "٣", "о", "Ｋ", "K", "①"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.sampled_from(FOLDS), max_size=12))
def test_gate_changes_nothing(parts):
    text = "".join(parts)
    assert all_spans(text) == ungated(text)
    assert disguised(text) or rewritten(text)[0] == text
