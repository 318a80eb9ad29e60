"""BPE encoding by a bounded-lookahead streaming transducer, decoding by an incremental byte-to-text machine.

The end of a text may change tokens only so far back: a merge sees its right neighbour, which exists or not because of
merges of lower rank further right, and so on, along a chain of falling ranks. ``sufficient_lookahead`` is the longest
such chain in symbols, from the merge list alone. Every word goes through the transducer, which reads symbols into a window
of bounded size, merges within it, emits the tokens that end at least that far before the window's end, and goes on from
there; what a word of ordinary length gives is kept in a bounded cache. The decoder is a machine of its own: it takes one
id after the other and gives the text that is sure by then. Digests are fed by both as they go.

Defined cases: a null or empty text has no tokens; special tokens written in a text are those tokens, as in the
library; a text is read in chunks of ``CHUNK`` characters that end between words, so beyond the text and its longest word
memory is constant (unless ids are asked for); rows that share an identifier are separate rows; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, plain_text
from .packing import byte_alphabet


def sufficient_lookahead(merges: list[tuple[str, str]], size=len) -> int:
    """Symbols right of a boundary that can still change whether it is one.

    need[t]: symbols from a token's left end that decide whether it stands there when a merge comes to it. A merge
    (a, b) of the next rank makes ab and uses up a as soon as b is there, so both now depend on what b needed.
    """
    need: dict[str, int] = {}
    most = 1
    for a, b in merges:
        reach = size(a) + max(need.get(b, 0), size(b))
        need[a + b] = max(need.get(a + b, 0), reach)
        need[a] = max(need.get(a, 0), reach)
        most = max(most, reach)
    return most


class Bpe:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    CACHED, CACHE_CHARS, LONG, CHUNK = 250_000, 40, 4096, 1 << 18
    _made: dict[str, "Bpe"] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.joined = [a + b for a, b in pairs]
        self.lookahead = sufficient_lookahead(pairs, lambda t: len(t.removesuffix(self.end)))
        self.window = max(512, 4 * self.lookahead)
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbol_byte = byte_alphabet()
        self.stand_ins = {b: c for c, b in self.symbol_byte.items()}
        self.cache: dict[str, tuple[str, str]] = {}

    @classmethod
    def of(cls, path: str) -> "Bpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges in a list of symbols: lowest rank first, then leftmost."""
        ranks = self.ranks
        if len(symbols) <= 64:
            symbols, none = list(symbols), len(self.joined)
            found = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
            while found and (best := min(found)) < none:
                i = found.index(best)
                symbols[i : i + 2] = [self.joined[best]]
                del found[i]
                if i < len(found):
                    found[i] = ranks.get((symbols[i], symbols[i + 1]), none)
                if i:
                    found[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
            return symbols
        tokens: list[str | None] = list(symbols)
        after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = a + b, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (a + b, tokens[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, *p))
            if (h := before[i]) >= 0 and (p := (tokens[h], a + b)) in ranks:
                heapq.heappush(heap, (ranks[p], h, *p))
        return [t for t in tokens if t is not None]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """The transducer: tokens of one word of any length, each one as soon as it is stable; the last symbol has the word's end."""
        symbols, held = iter(symbols), []
        while True:
            size = max(self.window, len(held) + 1)
            held.extend(islice(symbols, size - len(held)))
            if len(held) < size:
                break
            used, limit = 0, len(held) - self.lookahead - 1
            for token in self.merged(held):
                size = len(token.removesuffix(self.end))
                if used + size > limit:
                    break
                used += size
                yield token
            del held[:used]
        yield from self.merged(held)

    def symbols(self, word: str) -> Iterator[str]:
        """The symbols of a word, byte by byte; the last one has the word's end."""
        for start in range(0, len(word), self.LONG):
            part = word[start : start + self.LONG].encode("utf-8").decode("latin-1").translate(self.stand_ins)
            if start + self.LONG < len(word):
                yield from part
            else:
                yield from part[:-1]
                yield part[-1] + self.end

    def word(self, word: str) -> tuple[str, str]:
        """Of one word: its ids in decimal and its tokens' text, each joined by spaces."""
        if (known := self.cache.get(word)) is not None:
            return known
        ids = [self.vocab[t] for t in self.stream(self.symbols(word))]
        made = " ".join(map(str, ids)), self.decode(ids)
        if len(word) <= self.CACHE_CHARS:
            if len(self.cache) >= self.CACHED:  # the oldest half goes
                for old in list(islice(self.cache, self.CACHED // 2)):
                    del self.cache[old]
            self.cache[word] = made
        return made

    def chunks(self, text: str) -> Iterator[str]:
        """Pieces of bounded size that end before a space or line end, where neither normal forms nor words reach over."""
        start = 0
        while len(text) - start > self.CHUNK:
            end = max(text.rfind(" ", start + 1, start + self.CHUNK), text.rfind("\n", start + 1, start + self.CHUNK))
            if end < 0:
                found = regex.compile(r"[ \n]").search(text, start + 1)
                end = found.start() if found else len(text)
            yield text[start:end]
            start = end
        yield text[start:]

    def pieces(self, text: str) -> Iterator[tuple[list[str], list[str]]]:
        """Of a chunk after the other: ids in decimal and decoded texts, of words or of parts of a very long word."""
        cache, word = self.cache.get, self.word
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.specials:
                yield [str(self.specials[part])], [part]
                continue
            for chunk in self.chunks(part):
                if not chunk.isascii():
                    chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
                words = self.words.findall(chunk.lower())
                if not words:
                    continue
                if len(chunk) > self.LONG and max(map(len, words)) > self.LONG:
                    for w in words:
                        yield from self.long_word(w) if len(w) > self.LONG else [tuple([x] for x in word(w))]
                    continue
                pairs = [cache(w) or word(w) for w in words]
                yield [p[0] for p in pairs], [p[1] for p in pairs]

    def long_word(self, word: str) -> Iterator[tuple[list[str], list[str]]]:
        tokens = self.stream(self.symbols(word))
        while part := list(islice(tokens, 1024)):
            ids = [self.vocab[t] for t in part]
            yield [" ".join(map(str, ids))], [self.decode(ids)]

    def ids(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for part in ids for i in part.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode for a file without a decoder."""
        machine = Decoder(self, "tokens")
        return "".join(map(machine.feed, ids)) + machine.finish()

    def decoded_text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that the ids stand for, token by token."""
        machine = Decoder(self, "text")
        yield from map(machine.feed, ids)
        yield machine.finish()


class Decoder:
    """An incremental machine from ids to text; its state is a flag or the bytes of an unfinished character.

    'tokens' writes the bytes of each token in their printable stand-ins, a space between tokens, as the library does
    for a file without a decoder; 'text' writes the characters as soon as their bytes are complete, and word ends as spaces.
    """

    def __init__(self, bpe: Bpe, form: str) -> None:
        self.bpe, self.started = bpe, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace") if form == "text" else None
        self.feed = self.characters if form == "text" else self.token

    def token(self, i: int) -> str:
        before = " " if self.started else ""
        self.started = True
        return before + self.bpe.tokens[i]

    def characters(self, i: int) -> str:
        token = self.bpe.tokens[i]
        if token in self.bpe.specials:
            return self.finish() + token
        bare = token.removesuffix(self.bpe.end)
        return self.utf8.decode(bytes(self.bpe.symbol_byte[c] for c in bare)) + " " * (bare != token)

    def finish(self) -> str:
        if self.utf8 is None:
            return ""
        rest = self.utf8.decode(b"", True)
        self.utf8.reset()
        return rest


class Spaced:
    """SHA-256 of parts with a space between, fed as they come; ``kept`` has the parts themselves, if asked for."""

    def __init__(self, keep: bool) -> None:
        self.digest, self.started, self.spaces = hashlib.sha256(), False, 0
        self.kept: list[str] | None = [] if keep else None

    def put(self, parts: list[str]) -> None:
        text = " ".join(parts)
        if self.started:
            text = " " + text
        self.started = True
        self.spaces += text.count(" ")
        self.digest.update(text.encode("utf-8"))
        if self.kept is not None:
            self.kept.append(text)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def encode(batches):
        bpe = Bpe.of(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, decoded = Spaced(with_ids), Spaced(with_ids)
                for some_ids, some_text in bpe.pieces(text.as_py()):
                    ids.put(some_ids)
                    decoded.put(some_text)
                whole = [[int(i) for part in ids.kept for i in part.split()], "".join(decoded.kept)] if with_ids else []
                rows.append((doc_id, ids.spaces + ids.started, ids.digest.hexdigest(), decoded.digest.hexdigest(), *whole))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(F.col(id_col).cast("long").alias(id_col), plain_text(text_col).alias("text")).mapInArrow(encode, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
