"""SentencePiece encoding by a table of last tokens, one for each prefix, and decoding by id.

Merging "best piece first, then leftmost" gives every text one list of tokens. Two facts make it readable from a table.
A list of tokens is the encoding of its text exactly if each token encodes to itself and each two neighbours encode to
just those two (merges on both sides of a boundary never meet until one of them crosses it, so the first crossing would
show in the pair alone). Hence the encoding without its last token is the encoding of the shorter prefix. So for each
prefix one token is stored, its last: among the pieces that an Aho-Corasick automaton finds to end there, the only one
that is compatible with the last token of the prefix before it. The ids are then recovered backwards from the end.

``compatible`` replays the pair's merges along the right spine of the first token and the left spine of the second one,
and asks whether one across the boundary would come first; where ranks tie (runs of spaces) it merges the pair plainly.
Answers are kept: there are at most as many as pairs of pieces, and the table is bounded.

No piece has a space after another character, few have punctuation after a letter, and some characters are in no longer
piece, so texts are cut at such places into units that encode by themselves; all this is read from the vocabulary. The
tables of all new short units of some hundred kilobytes are filled together, in numpy, one position after the other.
Their results are kept in a bounded cache of two generations (a full one becomes the old one, whose entries come back
when they are used).

Defined cases: a null or empty text has the end id alone and decodes to the empty text; U+2581 in a text is a space, as
in the library; a character outside the vocabulary becomes its bytes; a text is read in chunks of ``CHUNK`` characters
that end between units, so beyond the text, its longest unit and the caches memory is constant (unless ids are asked
for); rows that share an identifier are separate rows, a null identifier stays; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, plain_text

SPACE, NEVER = "▁", 1 << 60


class Pieces:
    """A merge-type vocabulary with byte fallback, read from a SentencePiece model file; spaces are written as spaces."""

    CACHED, CACHE_CHARS, PAIR_BITS, LONG, CHUNK = 300_000, 40, 22, 4096, 1 << 18
    _made: dict[str, "Pieces"] = {}

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.end_id = model.eos_id()
        self.text = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain} | dict.fromkeys(special, "")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.id = {self.text[i]: i for i in plain}
        # merges of a higher score come first; equal scores have equal ranks
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {self.text[i]: place[model.get_score(i)] for i in plain}

        joined = {c for t in self.id if len(t) > 1 for c in t}
        if any(" " in t.lstrip(" ") for t in self.id):
            raise ValueError("a piece has a space after another character: texts cannot be cut before spaces")
        marks = {c for c in joined if c.isascii() and not c.isalnum()}
        others = joined - marks
        # characters that some piece has before a mark: there the text is not cut
        ties = {a for t in self.id for a, b in zip(t, t[1:]) if b in marks and a in others}
        some = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        tied = f"(?:(?<={some(ties)}){some(marks)}+)?" if ties else ""
        self.units = re.compile(f"{some(marks)}*(?:{some(others)}+{tied})+|{some(marks)}+|.", re.S)
        self.before_unit = re.compile(r"(?<! ) ")
        self.gap = "\n" if "\n" not in joined else next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in joined)

        self.automaton = ahocorasick.Automaton()
        self.length = {i: len(self.text[i]) for i in plain}
        self.right: dict[int, list[tuple[str, int]]] = {}
        self.left: dict[int, list[tuple[str, int]]] = {}
        self.strict: set[int] = set()
        for i in plain:
            text = self.text[i]
            tokens, tree = self.merged(text)
            if len(tokens) > 1:
                continue  # no merges lead to this piece
            if len(text) > 1:
                self.automaton.add_word(text, i)
            self.spines(i, text, tree)
        self.automaton.make_automaton()
        self.single = -np.arange(0x110000, dtype=np.int32) - 1  # a character's piece, or minus its code point
        for i in plain:
            if len(self.text[i]) == 1:
                self.single[ord(self.text[i])] = i
        self.sizes = np.ones(size, np.int64)
        self.sizes[list(self.length)] = list(self.length.values())
        self.names = [str(i) for i in range(size)]
        # answers of compatible(), each in the place that its pair's hash gives it
        self.pair_of, self.answer = np.full(1 << self.PAIR_BITS, -1, np.int64), np.zeros(1 << self.PAIR_BITS, bool)
        # ids of units in decimal, and the texts of those whose ids do not give the same text again
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.others: dict[str, str] = {}

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merged(self, text: str) -> tuple[list[str], dict[tuple[int, int], int]]:
        """Plain merging of a short text: its tokens, and where each merged span was cut."""
        cuts, spans = [*range(len(text) + 1)], {}
        while len(cuts) > 2:
            found = [self.rank.get(text[a:b], NEVER) for a, b in zip(cuts, cuts[2:])]
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            spans[cuts[at], cuts[at + 2]] = cuts[at + 1]
            del cuts[at + 1]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])], spans

    def spines(self, i: int, text: str, tree: dict[tuple[int, int], int]) -> None:
        """The nested parts of a token that end (start) where it does, smallest first, each with its parent's rank."""
        for side, own in ((self.right, 1), (self.left, 0)):
            span, parts, above = (0, len(text)), [], NEVER
            while True:
                part = text[span[0] : span[1]]
                parts.append((part, above))
                if span not in tree:
                    break
                cut, above = tree[span], self.rank[part]
                span = (cut, span[1]) if own else (span[0], cut)
            side[i] = parts[::-1]
        inner = [(self.rank[text[a:b]], [self.rank[text[x:y]] for x, y in ((a, m), (m, b)) if y - x > 1]) for (a, b), m in tree.items()]
        if all(child < parent for parent, children in inner for child in children):
            self.strict.add(i)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b encodes to these two (negative ids are characters without a piece)."""
        if a < 0 or b < 0:
            return True  # such a character is in no longer piece
        if a in self.strict and b in self.strict:
            return self.meet(a, b)
        return self.merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays, from the table of answers where it has them."""
        pairs = (np.maximum(a, 0).astype(np.int64) << 32) | b
        place = (pairs * np.int64(-7046029254386353131)) >> np.int64(64 - self.PAIR_BITS) & np.int64((1 << self.PAIR_BITS) - 1)
        fits = self.answer[place]
        unknown = np.flatnonzero((self.pair_of[place] != pairs) & (a >= 0))
        if len(unknown):
            new, at, back = np.unique(pairs[unknown], return_index=True, return_inverse=True)
            answers = np.array([self.compatible(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in new])
            fits[unknown] = answers[back]
            self.pair_of[place[unknown[at]]], self.answer[place[unknown[at]]] = new, answers
            # two new pairs in one place: the one written last stays, with its own answer
            kept = self.pair_of[place[unknown[at]]] == new
            self.answer[place[unknown[at]][kept]] = answers[kept]
        return fits | (a < 0)

    def meet(self, a: int, b: int) -> bool:
        right, left, x, y, rank = self.right[a], self.left[b], 0, 0, self.rank
        while True:
            (first, up), (second, over) = right[x], left[y]
            across = rank.get(first + second, NEVER)
            if across < up and across <= over and across < NEVER:
                return False
            if up == over == NEVER:
                return True
            if up <= over:
                x += 1
            else:
                y += 1

    def last_tokens(self, unit: str) -> list[int] | array:
        """For each prefix of a unit the last token of its encoding; minus the code point, less one, for a character without a piece."""
        n, compatible, known = len(unit), self.compatible, {}
        last = [0] * n if n <= self.LONG else array("i", bytes(4 * n))
        done = -1
        for p, token in self.automaton.iter(unit):
            for q in range(done + 1, p):
                if not last[q]:
                    last[q] = int(self.single[ord(unit[q])])
            done = p - 1
            if last[p]:
                continue
            before = p - self.length[token]
            if before >= 0:
                pair = last[before], token
                if pair not in known:
                    known[pair] = compatible(*pair)
                if not known[pair]:
                    continue
            last[p] = token
        for q in range(done + 1, n):
            if not last[q]:
                last[q] = int(self.single[ord(unit[q])])
        return last

    def tokens(self, unit: str) -> list[int]:
        """Ids of a unit, recovered backwards from its table."""
        last, ids, p, length = self.last_tokens(unit), [], len(unit) - 1, self.length
        while p >= 0:
            token = last[p]
            if token < 0:
                ids.extend(self.bytes[b] for b in reversed(chr(-token - 1).encode("utf-8")))
                p -= 1
            else:
                ids.append(token)
                p -= length[token]
        return ids[::-1]

    def tokens_of(self, units: list[str]) -> list[list[int]]:
        """``tokens`` of many short units at once; ids below zero stand for characters without a piece."""
        text = self.gap.join(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(sizes + 1) - sizes - 1
        last = self.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        start = np.repeat(first, sizes + 1)[: len(text)]  # of the unit at each place
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, token = found[:, 0], found[:, 1]
        before = end - self.sizes[token]
        depth = end - start[end]
        order = np.argsort(depth, kind="stable")
        ends = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
        for a, b in zip(ends, ends[1:]):
            some = order[a:b]  # the pieces that end at this place of their units
            inside = before[some] >= start[end[some]]
            fits = ~inside
            fits[inside] = self.all_compatible(last[before[some[inside]]], token[some[inside]])
            last[end[some[fits]]] = token[some[fits]]
        at, who, step = first + sizes - 1, np.arange(len(units)), 0
        ids, owner = [], []
        while len(who):
            ids.append(last[at])
            owner.append(who)
            at = at - self.sizes[np.maximum(ids[-1], 0)]
            more = at >= first[who]
            at, who = at[more], who[more]
        if not units:
            return []
        ids, owner = np.concatenate(ids)[::-1], np.concatenate(owner)[::-1]
        by_unit = np.argsort(owner, kind="stable")
        flat, cuts = ids[by_unit].tolist(), np.cumsum(np.bincount(owner, minlength=len(units))).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, units: set[str]) -> None:
        """Puts the results of all short units into the young cache."""
        new = units - self.young.keys()
        if len(self.young) + len(new) > self.CACHED:
            self.young, self.old = {}, self.young
            self.others = {u: t for u, t in self.others.items() if u in self.old}
            new = units
        short = [u for u in new if len(u) <= self.CACHE_CHARS]
        known = self.old.keys() & short
        self.young.update((u, self.old[u]) for u in known)
        unknown = [u for u in short if u not in known] if known else short
        young, names, texts = self.young, self.names, self.text
        for unit, ids in zip(unknown, self.tokens_of(unknown)):
            if min(ids) < 0:
                young[unit], text = self.written(self.tokens(unit))
            else:
                young[unit] = " ".join([names[i] for i in ids])
                text = "".join([texts[i] for i in ids])  # no bytes among them
            if text != unit:
                self.others[unit] = text

    def written(self, ids: list[int]) -> tuple[str, str]:
        """Ids in decimal, joined by spaces, and their text."""
        return " ".join(map(str, ids)), self.characters(ids)

    def chunks(self, text: str) -> Iterator[str]:
        """Pieces of bounded size that end before a run of spaces; a text has one space more at its start."""
        start, head = 0, " "
        while len(text) - start > self.CHUNK:
            found = self.before_unit.search(text, start + self.CHUNK)
            if not found:
                break
            yield head + text[start : found.start()]
            start, head = found.start(), ""
        yield head + text[start:]

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[int, list[str], list[str], bool]]:
        """Of each text, a chunk after the other: its number, ids in decimal and texts of the units, and whether it ends; the end id is last."""
        held, size = [], 0
        for number, text in enumerate(texts):
            if text:
                for chunk in self.chunks(text.replace(SPACE, " ")):
                    held.append((number, self.units.findall(chunk), False))
                    size += len(chunk)
                    if size >= self.CHUNK:
                        yield from self.flush(held)
                        held, size = [], 0
            held.append((number, [], True))
        yield from self.flush(held)

    def flush(self, held: list[tuple[int, list[str], bool]]) -> Iterator[tuple[int, list[str], list[str], bool]]:
        self.learn(set().union(*[units for _, units, _ in held]))
        others = self.others.get
        for number, units, ends in held:
            if ends:
                yield number, [str(self.end_id)], [""], True
                continue
            ids, texts = list(map(self.young.get, units)), [others(u, u) for u in units] if self.others else units
            if None in ids:  # units that are too long to be kept
                texts = list(texts)
                for at, known in enumerate(ids):
                    if known is None:
                        ids[at], texts[at] = self.written(self.tokens(units[at]))
            yield number, ids, texts, False

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, ids, _, _ in self.parts([text]) for part in ids for i in part.split()]

    def characters(self, ids: Iterable[int]) -> str:
        """Pieces and bytes as text; a byte that belongs to no character is U+FFFD."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(from_bytes(held))
                held.clear()
            out.append(self.text[i])
        return "".join(out) + (from_bytes(held) if held else "")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space that encoding puts before a text goes."""
        return self.characters(ids).removeprefix(" ")


def from_bytes(held: bytes | bytearray) -> str:
    """UTF-8 characters; each byte of what is no character is U+FFFD."""
    out, at = [], 0
    while at < len(held):
        try:
            out.append(held[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(held[at : at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def encode(batches):
        pieces = Pieces.of(model)
        for batch in batches:
            names_of, rows, state = batch.column(0).to_pylist(), [], None
            for number, ids, parts, ends in pieces.parts(t.as_py() for t in batch.column(1)):
                digest, decoded, n, kept, texts = state or (hashlib.sha256(), hashlib.sha256(), 0, [], [])
                joined, written = " ".join(ids), "".join(parts)
                digest.update((" " + joined if n else joined).encode("ascii"))
                written = written if n else written.removeprefix(" ")
                decoded.update(written.encode("utf-8"))
                state = digest, decoded, n + joined.count(" ") + 1, kept, texts
                if with_ids:
                    kept.extend(map(int, joined.split(" ")))
                    texts.append(written)
                if ends:
                    rows.append((names_of[number], state[2], digest.hexdigest(), decoded.hexdigest(), *([kept, "".join(texts)] if with_ids else [])))
                    state = None
            yield pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(names)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(F.col(id_col).cast("long").alias(id_col), plain_text(text_col).alias("text")).mapInArrow(encode, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
