"""Porter's published suffix stripping, one word at a time (used on distinct words only)."""

from __future__ import annotations

import re


# fixed values: the suffixes of steps 2 to 4 of the published algorithm
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c", shape(stem)))


def short_end(stem: str) -> bool:
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (s := longest(w, ("ed", "ing"))) and "v" in shape(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double_end(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short_end(w):
            w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := longest(w, table)) and measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if s := longest(w, STEP4):
        stem = w[: -len(s)]
        if measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            w = w[:-1]
    if measure(w) > 1 and double_end(w) and w.endswith("l"):
        w = w[:-1]
    return w
