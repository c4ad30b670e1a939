"""Token counts by a compiled finite-state transducer.

The tokenizer file (BPE with an end-of-word mark) is compiled to a deterministic transducer over
the bytes of a word. Which token ends a prefix follows from pairs alone: an encoding is right if each
of its adjacent pairs is the encoding of its own concatenation. So the last token is the longest one
ending the prefix whose pair with the last token before it holds.

What comes later depends on few things: the places from which the bytes read so far begin a token, and
for each the last token before it and how many tokens lie between it and here. That is a state; equal
ones are one, whatever words led there. Each transition says how many tokens the longer prefix has more
(or fewer), so a walk over all symbols of a word adds up its token count. States come into being when a
word first needs them (lazy determinisation), up to a bound; walks of whole words are remembered.

A text is cut into chunks. A chunk's map is (head, count, tail): the word begun before it, the tokens
of what is settled, the word it leaves open. White space always ends a word, so maps compose
associatively and a text's count is the reduction of a balanced scan over its chunks.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 16
#: States kept at most in one worker; then they are dropped and made again.
STATES = 100_000
#: Different words whose counts a worker keeps.
WORDS = 400_000


class Spec(NamedTuple):
    """What is needed of a tokenizer file: merges as pairs of symbols, special strings, the word pattern."""

    merges: list[tuple[str, str]]
    special: list[str]
    pattern: str
    suffix: str


def read_spec(path: str) -> Spec:
    """Reads a tokenizer file of this kind: NFC, white space, lower case; split by a pattern; byte-level BPE with a suffix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or not model["end_of_word_suffix"]:
        raise ValueError(f"not a word-end byte-level BPE file: {path}")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Spec(pairs, [t["content"] for t in spec["added_tokens"]], split["pattern"]["Regex"], model["end_of_word_suffix"])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Transducer:
    """Counts tokens of words and whole texts. Symbols are characters: a byte b is chr(b), at a word's end chr(256 + b)."""

    def __init__(self, spec: Spec):
        code = {c + mark: chr(b + 256 * bool(mark)) for b, c in enumerate(byte_letters()) for mark in ("", spec.suffix)}
        #: Pair of tokens (as symbol strings) -> rank of their merge.
        self.rank: dict[tuple[str, str], int] = {}
        #: Token -> the pair it was merged from last.
        self.made_of: dict[str, tuple[str, str]] = {}
        for k, (a, b) in enumerate(spec.merges):
            pair = code[a], code[b]
            code.setdefault(a + b, "".join(pair))
            self.rank.setdefault(pair, k)
            self.made_of.setdefault("".join(pair), pair)
        self.tokens = {t for t in code.values() if self.merged(t) == [t]}
        #: What a longer token begins with.
        self.begins = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.pattern = regex.compile(spec.pattern)
        self.special = regex.compile("|".join(map(regex.escape, spec.special))) if spec.special else None
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: Per state: symbol -> (next state, tokens more); its places, longest first: (bytes since, last token before, tokens before less those here).
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.places: list[tuple[tuple[str, str, int], ...]] = [(("", "", 0),)]
        self.number = {self.places[0]: 0}

    def merged(self, symbols: str) -> list[str]:
        """Merges by rank: the definition, for single tokens."""
        s = list(symbols)
        while len(s) > 1:
            k, i = min((self.rank.get((s[i], s[i + 1]), 1 << 60), i) for i in range(len(s) - 1))
            if k == 1 << 60:
                break
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces at one end of a token while it is merged, each with the rank of the merge that ends it."""
        known = self.edges.get((token, side))
        if known is None:
            known, end, t = [], 1 << 60, token
            while True:
                known.append((t, end))
                if t not in self.made_of:
                    break
                end = self.rank[self.made_of[t]]
                t = self.made_of[t][side]
            self.edges[token, side] = known
        return known

    def holds(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b again: no merge across the border comes before those that end its pieces."""
        known = self.pairs.get((a, b))
        if known is None:
            rank = self.rank
            known = not any(k < x_end and k <= y_end for x, x_end in self.edge(a, 1) for y, y_end in self.edge(b, 0) if (k := rank.get((x, y))) is not None)
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """Adds the transition by a symbol: (next state, tokens more)."""
        longer = [(since + symbol, last, count) for since, last, count in self.places[state]]
        token, more = next((t, count + 1) for t, last, count in longer if t in self.tokens and (not last or self.holds(last, t)))
        places = (*[(t, last, count - more) for t, last, count in longer if t in self.begins], ("", token, 0))
        to = self.number.setdefault(places, len(self.places))
        if to == len(self.places):
            self.places.append(places)
            self.next.append({})
        found = self.next[state][symbol] = (to, more)
        return found

    def word(self, word: str) -> int:
        """Tokens of one word of the pattern: the sum of its transitions."""
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.places) > STATES:
            self.clear()
        raw = word.encode()
        state = total = 0
        moves = self.next
        for c in raw[:-1].decode("latin-1") + chr(256 + raw[-1]):
            state, more = moves[state].get(c) or self.step(state, c)
            total += more
        self.words[word] = total
        return total

    def settled(self, text: str) -> int:
        """Tokens of a text that begins and ends at word ends."""
        if self.special and "<|" in text:
            found = self.special.findall(text)
            if found:
                return len(found) + sum(map(self.settled, self.special.split(text)))
        if not text.isascii():
            # letters are lowered one by one: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, word = self.words, self.word
        return sum([known.get(w) or word(w) for w in self.pattern.findall(text.lower())])

    def chunk(self, text: str) -> tuple[str, int, str] | str:
        """A chunk's map; a chunk without white space is open at both ends: a mere string."""
        first = regex.search(r"\s", text)
        if not first:
            return text
        end = len(text)
        while not text[end - 1].isspace():
            end -= 1
        return text[: first.start()], self.settled(text[first.start() : end]), text[end:]

    def compose(self, a, b):
        if isinstance(a, str) and isinstance(b, str):
            return a + b
        if isinstance(a, str):
            return a + b[0], b[1], b[2]
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.settled(a[2] + b[0]) + b[1], b[2]

    def text(self, text: str) -> int:
        """Tokens of a whole text."""
        if len(text) <= CHUNK:
            return self.settled(text)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # a balanced scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        whole = maps[0]
        return self.settled(whole) if isinstance(whole, str) else self.settled(whole[0]) + whole[1] + self.settled(whole[2])


_made: dict[int, Transducer] = {}


def _compiled(shared) -> Transducer:
    """One transducer for each worker process and broadcast."""
    key = hash(tuple(shared.value.merges))
    if key not in _made:
        _made[key] = Transducer(shared.value)
    return _made[key]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compiled(shared)
        for batch in batches:
            counts = [made.text(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row of docs: id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: path of the file, read by the driver only. A null text is empty: 0 bytes and tokens.
    Special strings inside texts are one token each. Repeated rows are counted one by one; other
    columns are ignored, whatever their names.
    """
    sc: SparkContext = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    rows = rows.select("text", "id", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = rows.mapInArrow(_count(sc.broadcast(read_spec(tokenizer))), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
