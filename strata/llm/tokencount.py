"""Token counts by a compiled finite-state tokenizer.

The byte-pair merges are compiled into a deterministic transducer. Its input symbols are the
bytes of a word piece, the last one marked as final; every transition is annotated with the
change of the token count, so a piece's count is the sum along its path. The transducer rests
on two facts about merges: the tokens of a prefix of a piece end in one definite last token,
and a token may follow another exactly if the two, merged from bytes, give just these two. A
state is therefore the part of the piece that can still grow into a vocabulary token, with the
last token and the count at each of its positions. States are made when first reached.

A text is a sequence of chunks. White space is dropped by this vocabulary and sets the
transducer back to its start, so a chunk's state map is known without the state before it: an
open head up to the first blank, the count of all whole words, and an open tail. Maps compose
associatively, and the maps of a text's chunks are combined by a parallel prefix scan (pairs of
neighbours, round by round).

Special strings in a text count as one token each, as the library has it by default.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted
alike; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .tokenize import VOCABULARY, vocabulary_path

LIMIT = 2048
#: Characters of a chunk.
CHUNK = 1 << 16
#: Memory bounds of a worker: states and distinct words are forgotten beyond these.
MAX_STATES = 200_000
MAX_WORDS = 500_000
#: White space of the vocabulary's patterns (fixed values).
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Pieces of an ASCII word (the vocabulary's pattern; fixed values).
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")


class CountTransducer:
    """Counts the tokens of a word piece given as byte-level characters."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.vocabulary = vocabulary
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(merges)}
        self.prefixes = {""}
        for t in vocabulary:
            t = t.removesuffix(suffix)
            self.prefixes.update(t[:i] for i in range(1, len(t) + 1))
        self.fits: dict[tuple, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: (open text, last tokens, counts relative to now) and its transitions
        self.start = self.states = None
        self.start = ("", (None,), (0,), {})
        self.states = {self.start[:3]: self.start}

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix):
            t = token.removesuffix(self.suffix)
            return [*t[:-1], t[-1] + self.suffix] if t else [token]
        return list(token)

    def _merged(self, s: list[str]) -> list[str]:
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s = [*s[:best], s[best] + s[best + 1], *s[best + 2:]]
        return s

    def _may_follow(self, left: str | None, token: str) -> bool:
        found = self.fits.get((left, token))
        if found is None:
            want = [token] if left is None else [left, token]
            found = self.fits[(left, token)] = self._merged([x for t in want for x in self._symbols(t)]) == want
        return found

    def _step(self, state, char: str, final: bool):
        text, last, counts, _ = state
        grown = text + char
        for k in range(len(grown)):  # the token that ends here starts at k
            token = grown[k:] + (self.suffix if final else "")
            if token in self.vocabulary and self._may_follow(last[k], token):
                break
        else:
            raise ValueError(f"no token ends at {char!r}")
        delta = counts[k] + 1
        if final:
            return None, delta
        while grown not in self.prefixes:
            grown, last, counts = grown[1:], last[1:], counts[1:]
        key = (grown, (*last, token), (*(c - delta for c in counts), 0))
        new = self.states.get(key)
        if new is None:
            if len(self.states) >= MAX_STATES:
                self._reset()
                self.fits.clear()
            new = self.states[key] = (*key, {})
        return new, delta

    def count(self, piece: str) -> int:
        state, total, end = self.start, 0, len(piece) - 1
        for i, char in enumerate(piece):
            edge = char if i < end else char + self.suffix
            found = state[3].get(edge)
            if found is None:
                found = state[3][edge] = self._step(state, char, i == end)
            state = found[0]
            total += found[1]
        return total


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state before it: no blank: all of it is ``head``; else the open
    head, the tokens of its whole words, and the open tail."""

    blank: bool
    head: str
    count: int = 0
    tail: str = ""


class TokenCounter:
    """Token counts of whole texts for one vocabulary file."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer
        path = path or vocabulary_path(VOCABULARY)
        self.library = Tokenizer.from_file(path)  # for its normaliser and its piece pattern
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.transducer = CountTransducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.known: dict[str, int] = {}

    def _pieces(self, word: str) -> list[str]:
        """Byte-level pieces of a word without special strings."""
        if word.isascii():
            pieces = ASCII_PIECE.findall(word.lower())
            if all("!" <= c <= "~" for c in word):
                return pieces  # printable ASCII stands for itself
        normal = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def word(self, word: str) -> int:
        """Tokens of a blank-free word."""
        if not word:
            return 0
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            parts = SPECIAL.split(word) if "<|" in word else [word]
            n = len(parts) - 1 + sum(self.transducer.count(p) for x in parts for p in (self._pieces(x) if x else ()))
            self.known[word] = n
        return n

    def chunk(self, text: str) -> ChunkMap:
        words = BLANK.split(text) if any("\x1c" <= c <= "\x1f" for c in text) else None
        if words is None:
            words = text.split()
            if text[:1].isspace():
                words.insert(0, "")
            if text[-1:].isspace():
                words.append("")
        if len(words) < 2:
            return ChunkMap(False, words[0] if words else "")
        get, word = self.known.get, self.word
        n = 0
        for w in words[1:-1]:
            c = get(w)
            n += word(w) if c is None else c
        return ChunkMap(True, words[0], n, words[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not a.blank:
            return ChunkMap(b.blank, a.head + b.head, b.count, b.tail)
        if not b.blank:
            return ChunkMap(True, a.head, a.count, a.tail + b.head)
        return ChunkMap(True, a.head, a.count + self.word(a.tail + b.head) + b.count, b.tail)

    def text(self, text: str) -> int:
        maps = [self.chunk(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)] or [ChunkMap(False, "")]
        while len(maps) > 1:  # one round of the scan
            odd = maps[len(maps) - len(maps) % 2:]
            maps = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])] + odd
        m = maps[0]
        return self.word(m.head) + m.count + self.word(m.tail)


_COUNTERS: dict[str, TokenCounter] = {}


def _counter() -> TokenCounter:
    """This worker process's counter: states and known words outlive a task."""
    path = vocabulary_path(VOCABULARY)
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                     ("over_limit", pa.bool_())])


def token_counts(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    arrow_batches(documents.sparkSession)

    def count(batches):
        counter = _counter()
        for b in batches:
            n = [counter.text(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()),
                                              pa.array([x > limit for x in n], pa.bool_())], schema=_SCHEMA)
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                            F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
