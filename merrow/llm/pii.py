"""Personal data by offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it is. A transducer then rewrites disguises:
look-alike and full-width characters, invisible characters, spelled digits, "plus", and disguised at and dot signs. It
keeps, for every character written, the source range it stands for. The same detectors run on the rewritten text;
what they find is mapped back to source ranges and added, if a rewritten character takes part and no base span of the
kind holds the whole of it: a base span may be the plain tail of a disguised identifier, and both are reported then.
All detectors are linear in the text's length, and so is the comparison of added with base spans.

Defined cases: a null or empty text has no spans; a text of any length is read whole; an empty table gives no rows; a bare word "at" counts only between a name and a domain with a
disguised dot; spans are code points, end exclusive; rows that share an identifier are separate rows; further
columns are ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, plain_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

NAME = re.compile(r"[A-Za-z0-9._%+-]*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ sign: the name runs back to the last match, the domain follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def identifiers(text: str) -> list[Span]:
    """The base spans, kind after kind, by start."""
    out = emails(text) if "@" in text else []
    if not DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# fixed values: letters of other scripts that look like Latin ones
LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅԌαορυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhqwABEKMHOPCTYXIJSGaopuiABEZHIKMNOPTYX",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
NUMBER_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}

_NUMBER = "(?:" + "|".join(NUMBER_WORDS) + ")"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
TRIGGER = re.compile(rf"\b(?i:dot|{_NUMBER[3:-1]})\b|\b(?i:plus)\s[0-9(]|{_OPEN}\s?(?i:at|dot|@|\.)\s?{_CLOSE}")  # every match of REWRITE has one
REWRITE = re.compile(
    rf"(?P<at>\s?{_OPEN}\s?(?i:at|@)\s?{_CLOSE}\s?|(?<=[A-Za-z0-9])\s(?i:at)\s(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s(?i:dot)\s|\s?{_OPEN}\s?(?i:dot|\.)\s?{_CLOSE}\s?)[A-Za-z0-9]))"
    rf"|(?P<dot>\s?{_OPEN}\s?(?i:dot|\.)\s?{_CLOSE}\s?|(?<=[A-Za-z0-9])\s(?i:dot)\s(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\b(?i:plus)\s(?=[0-9(]|(?i:{_NUMBER})\b))"
    rf"|(?P<number>\b(?i:{_NUMBER})\b(?:[ -](?=(?i:{_NUMBER})\b))?)"
)


@cache
def fold(c: str) -> str:
    """A character beyond ASCII as what it looks like: an ASCII character, nothing if invisible, or itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    digit = unicodedata.decimal(c, None)
    plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


def folded(text: str) -> tuple[str, list[int]]:
    """Look-alikes and compatibility forms as ASCII, invisible characters gone; the source position of each character."""
    out, kept = [], []
    for i, c in enumerate(text):
        plain = c if c < "\x80" else fold(c)
        if plain:
            out.append(plain)
            kept.append(i)
    return "".join(out), kept


def disguised(text: str) -> bool:
    """Whether ``rewritten`` may change the text."""
    return not text.isascii() and any(c >= "\x80" and fold(c) != c for c in set(text)) or bool(TRIGGER.search(text))


def rewritten(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """The text without disguises; for each of its characters the source start, the source end, and changes before it."""
    plain, source = folded(text)
    out, starts, ends, changed = [], [], [], [0]

    def copy(a: int, b: int) -> None:
        out.append(plain[a:b])
        for i in range(a, b):
            starts.append(source[i])
            ends.append(source[i] + 1)
            gap = i > 0 and source[i] - source[i - 1] > 1
            changed.append(changed[-1] + (plain[i] != text[source[i]] or gap))

    done = 0
    for m in REWRITE.finditer(plain):
        copy(done, m.start())
        word = m[0].strip(" -").lower()
        out.append({"at": "@", "dot": ".", "plus": "+"}.get(m.lastgroup) or NUMBER_WORDS[word])
        starts.append(source[m.start()])
        ends.append(source[m.end() - 1 - (len(m[0]) - len(m[0].rstrip(" -")) if m.lastgroup == "number" else 0)] + 1)
        changed.append(changed[-1] + 1)
        done = m.end()
    copy(done, len(plain))
    return "".join(out), starts, ends, changed


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the rewritten text has beyond the base spans, by source ranges."""
    plain, starts, ends, changed = rewritten(text)
    known = {kind: [s for s in base if s[0] == kind] for kind in KINDS}
    at, added = dict.fromkeys(KINDS, 0), []
    for kind, a, b in identifiers(plain):  # both sides go by start, so each kind's base spans are passed once
        if changed[b] > changed[a]:
            start, end = starts[a], ends[b - 1]
            spans, i = known[kind], at[kind]
            while i < len(spans) and spans[i][2] < end:
                i += 1
            at[kind] = i
            if i == len(spans) or spans[i][1] > start:
                added.append((kind, start, end))
    return added


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base, added) spans of a text."""
    base = identifiers(text)
    return base, added_spans(text, base) if disguised(text) else []


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base counts by kind, hash of the base spans, all spans, number of spans added."""
    schema = pa.schema(
        [(id_col, pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    )

    def find(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, added = all_spans(text.as_py())
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    ddl = f"{id_col} long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias(id_col), plain_text(text_col).alias("text")).mapInArrow(find, ddl)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one mask."""
    if not text:
        return text
    base, added = all_spans(text)
    out, done = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all personal data masked in the text; other columns stay, a null text stays null."""
    schema = docs.schema

    def mask(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([masked(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(mask, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
