"""Token ids of whole texts by the public word-level BPE vocabulary."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces that a worker keeps the ids of before it starts anew (memory bound only).
KEPT_PIECES = 800_000
#: Bytes of texts that are cut at once.
GROUP = 4 << 20
#: Blanks that this vocabulary drops; the byte classes below know six others.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Letters beyond ASCII that are composed already and whose lower case is one letter of the same
#: range: Latin-1 and Latin Extended-A, but for the dotted capital I.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Classes of bytes. A word with a byte of no class goes through the whole library.
BLANK, LETTER, DIGIT, SIGN, NONE = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, NONE, np.uint8)
    out[0x21:0x7F] = SIGN
    out[[0x20, *range(0x09, 0x0E)]] = BLANK
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    out[0x30:0x3A] = DIGIT
    return out


_KIND = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Lower case of the letters of two bytes, 0 for other characters.
_LATIN_LOWER = np.array([ord(chr(c).lower()[0]) if re.match(f"[{_LATIN}]", chr(c)) else 0 for c in range(0x180)], np.uint16)
_Q = ord("'")


def cut(raw: np.ndarray):
    """Pieces of UTF-8 bytes that end in three blanks (the vocabulary's pattern on each blank-separated
    word: a contraction, a run of letters, a digit, or a run of other signs; fixed values).

    Returns their bytes one after the other, letters in lower case, the places where they start in ``raw``
    and in those bytes, and the numbers of those that are whole words as they are, for the library."""
    kind, low = _KIND[raw], _LOWER[raw]
    two = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    lower = _LATIN_LOWER[(raw[two] & 0x1F).astype(np.uint16) << 6 | raw[two + 1] & 0x3F]
    two, lower = two[lower > 0], lower[lower > 0]
    kind[two] = kind[two + 1] = LETTER
    low[two], low[two + 1] = 0xC0 | lower >> 6, 0x80 | lower & 0x3F
    before = np.concatenate([np.array([BLANK], np.uint8), kind[:-1]])
    text = kind != BLANK
    start = text & ((kind != before) | (kind == DIGIT))
    q = np.flatnonzero(start & (raw == _Q))
    a, b = low[q + 1], low[q + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    more = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    q, end = q[one | more], (q + np.where(one, 2, 3))[one | more]
    start[q + 1] = False
    start[end] = text[end]
    begin = np.flatnonzero((kind == NONE) | (raw == ord("<")) & (np.roll(raw, -1) == ord("|")))
    if len(begin):
        words = np.flatnonzero(text & (before == BLANK))
        at = np.unique(np.searchsorted(words, begin, "right") - 1)
        begin, end = words[at], np.flatnonzero(~text & (before != BLANK))[at]
        edge = np.zeros(len(raw), np.int8)
        edge[begin], edge[end] = 1, -1
        whole = np.cumsum(edge, dtype=np.int8) > 0
        start[whole], low[whole] = False, raw[whole]
        start[begin] = True
    starts = np.flatnonzero(start)
    return low[text], starts, (np.cumsum(text) - 1)[starts], np.searchsorted(starts, begin)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_symbols() -> dict[int, str]:
    """The vocabulary's character for each byte: printable bytes stand for themselves, the
    others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts. The vocabulary drops white space and never merges across it, so a
    text's ids are those of its blank-separated words, and a word's ids those of its pieces.
    Texts are cut into pieces many at a time as arrays of bytes, each distinct piece of them is looked up
    once, and each new one merged once by the library's model. Words of other than ASCII
    and simple Latin letters go through the whole library."""

    def __init__(self, path: str | None = None):
        import json
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        path = path or vocabulary_path()
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"]["end_of_word_suffix"]
        size = max(spec["model"]["vocab"].values()) + 1
        self.ends = np.zeros(size, bool)  # tokens that end a piece
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        # the model alone: its input is pieces in byte symbols, between single spaces
        spec.update(normalizer=None, pre_tokenizer={"type": "WhitespaceSplit"}, added_tokens=[])
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.symbols = _byte_symbols() | {0x20: " "}  # no piece holds a space
        self.pieces: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _merge(self, pieces: list[bytes]) -> None:
        """Learn the ids of new pieces."""
        for at in range(0, len(pieces), 4096):
            part = pieces[at:at + 4096]
            line = b" ".join(part)
            line = line.decode() if line.isascii() else line.decode("latin-1").translate(self.symbols)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            cuts = (4 * np.nonzero(self.ends[ids])[0] + 4).tolist()
            raw = ids.tobytes()
            for p, a, b in zip(part, [0, *cuts], cuts, strict=False):
                self.pieces[p] = raw[a:b]
            if len(cuts) != len(part) or cuts[-1] != len(raw):
                raise ValueError("a piece does not end in an end token")

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts that are cut at once."""
        data, starts, at, whole = cut(np.frombuffer(b" ".join([*texts, b"  "]), np.uint8))
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        at = np.append(at, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        keys, known = found.dictionary.to_pylist(), self.pieces
        if len(known) > KEPT_PIECES:
            known.clear()
        for k in np.unique(found.indices.to_numpy()[whole]).tolist():  # such a word is never equal to a piece
            if keys[k] not in known:
                known[keys[k]] = self._ids(keys[k].decode()).tobytes()
        self._merge([k for k in keys if k not in known])
        ids = pa.array(map(known.__getitem__, keys), pa.large_binary()).take(found.indices)
        _, ends, raw = ids.buffers()
        first = np.cumsum([0, *[len(t) + 1 for t in texts]])
        ends = np.frombuffer(ends, np.int64)[np.searchsorted(starts, first)] // 4
        raw = np.frombuffer(raw, np.uint32) if ends[-1] else np.zeros(0, np.uint32)
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out, group, size = [None] * len(texts), [], 0
        for n, t in enumerate(texts):
            t = t or ""
            if any(c in t for c in _ODD):
                out[n] = self._ids(t)
                continue
            group.append((n, t.encode()))
            size += len(group[-1][1])
            if size >= GROUP:
                self._fill(out, group)
                group, size = [], 0
        if group:
            self._fill(out, group)
        return out

    def _fill(self, out: list, group: list) -> None:
        for (n, _), ids in zip(group, self._group([raw for _, raw in group])):
            out[n] = ids


_ENCODERS: dict[str, Encoder] = {}


def encoder() -> Encoder:
    """This worker process's encoder: known words outlive a task."""
    path = vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
