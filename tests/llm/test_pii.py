import re

from hypothesis import given, settings
from hypothesis import strategies as st

from merrow.llm.pii import KINDS, all_spans, identifiers, luhn, masked

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1250+@.-_ ()%é", max_size=40))
def test_base_is_the_plain_patterns(text):
    assert identifiers(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4539 1488 0343 6467", "10.0.0.1", "300.1.1.1", "a.b@c.de_f@g.h", "+1 (246) 555-8210", " ", "1", "x", "@", "."]), max_size=8))
def test_base_on_likely_parts(parts):
    text = "".join(parts)
    assert identifiers(text) == brute(text)


def added(text):
    return [(k, text[a:b]) for k, a, b in all_spans(text)[1]]


def test_disguises_map_back_to_the_source():
    assert added("mail jo.doe (at) mail [dot] example.com now") == [("email", "jo.doe (at) mail [dot] example.com")]
    assert added("mail jo at mail dot example dot com now") == [("email", "jo at mail dot example dot com")]
    assert added("jo@mail dot com") == [("email", "jo@mail dot com")]
    assert added("jоe@mаil.com") == [("email", "jоe@mаil.com")]
    assert added("ｊoe＠mail．com!") == [("email", "ｊoe＠mail．com")]
    assert added("call plus one two four six 555 eight two one zero ok") == [("phone", "plus one two four six 555 eight two one zero")]
    assert added("ip ten, 10 dot 0 dot 0 dot one.") == [("ip", "10 dot 0 dot 0 dot one")]
    four = "four five three nine one four eight eight zero three four three six four six seven"
    assert added(four + " end") == [("card", four)]
    assert added("1​0.0.0.1") == [] or added("1​0.0.0.1")[0][0] == "ip"


def test_disguises_beside_plain_tails():
    assert all_spans("jоhn@example.com") == ([("email", 2, 16)], [("email", 0, 16)])
    assert masked("mail jоhn@example.com, ann@x.org") == "mail [EMAIL], [EMAIL]"
    assert all_spans("a jo@mail.com dot au b") == ([("email", 2, 13)], [("email", 2, 20)])
    assert masked("a jo@mail.com dot au b") == "a [EMAIL] b"
    for disguise in ("jоhn@example.com", "ann (at) b.com", "call plus 14155552671"):
        text = f"ann@x.org {disguise}, 10.0.0.1, ann@x.org "
        base, more = all_spans(text)
        assert len(more) == 1 and masked(text).count("[") == 4


def test_many_base_and_added_spans_are_compared_in_one_pass():
    text = "jоhn@example.com 10.0.0.1 " * 20_000
    base, more = all_spans(text)
    assert len(base) == 40_000 and len(more) == 20_000


def test_clean_text_gains_nothing():
    for text in ["", "meet me at home one day", "see you at example.com", "one two three", "a dot b", "voilà l'été à Paris", "Ελλάδα и Россия"]:
        assert all_spans(text) == ([], [])


def test_long_runs_are_linear():
    for text in ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" + "(" * 200_000, "1." * 100_000, "one " * 50_000]:
        all_spans(text)


def test_masked():
    assert masked("x jo@mail.com y 10.0.0.1") == "x [EMAIL] y [IP]"
    assert masked(None) is None and masked("") == ""
