"""Token ids of whole texts, by the tokenizers library, each distinct word encoded once.

The vocabulary's normaliser and splitter treat ASCII white space as a hard
border, so a text's ids are the ids of its white-space separated words in
order. A worker keeps the ids of the words it has met in one flat array and
builds a text's ids by gathering. The word memory is emptied when it passes a
bound; results don't depend on it.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np
import public_tokenizers

from plaza.llm.common import worker_memory

WORD_BPE = "word_bpe_49k.json"
END = 1


def vocabulary_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


def _visible() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_VISIBLE = _visible()
_ASCII = re.compile(rb"[!-&(-~]+")
_ENDS = frozenset(b".,;:!?)%#*$&|-0123456789"[k : k + 1] for k in range(24))
_PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


class _Seen(dict):
    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class WordTokenizer:
    def __init__(self, path: str, most_words: int = 700_000, most_ids: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ask = self.model.model.tokenize
        self.bounds = most_words, most_ids
        self.forget()

    def forget(self):
        """Empty the word memory; the model stays."""
        self.seen = _Seen()
        self.pieces: dict[bytes, bytes] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.known = 0

    def _learn(self):
        for at in range(0, len(self.seen.new), 4096):
            words = self.seen.new[at : at + 4096]
            got = [self._plain(w) for w in words]
            odd = [k for k, x in enumerate(got) if x is None]
            for k, e in zip(odd, self.model.encode_batch_fast([words[k].decode() for k in odd], add_special_tokens=False)):
                got[k] = array("I", e.ids).tobytes()
            counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
            total = int(counts.sum())
            self.flat = _room(self.flat, self.used + total)
            self.start, self.count = (_room(x, self.known + len(got)) for x in (self.start, self.count))
            self.flat[self.used : self.used + total] = np.frombuffer(b"".join(got), np.uint32)
            self.start[self.known : self.known + len(got)] = self.used + np.cumsum(counts) - counts
            self.count[self.known : self.known + len(got)] = counts
            self.known += len(got)
            self.used += total
        self.seen.new.clear()

    def _plain(self, word: bytes) -> bytes | None:
        """The ids (packed) of a word whose splitting and lower case are plain; None if it is another.

        Plain are visible ASCII without an apostrophe, cut into runs of letters,
        single digits and runs of marks, and Latin letters with at most one full
        stop or comma after them. Each piece is asked of the model itself, once.
        """
        core, last = word[:-1], word[-1:]
        if word.isalpha():
            return self._piece(word.lower())
        if core.isalpha():
            return self._piece(core.lower()) + self._piece(last) if last in _ENDS else None
        if _ASCII.fullmatch(word) and b"<|" not in word:
            return b"".join(map(self._piece, _PIECES.findall(word.lower())))
        mark = last in (b".", b",")
        text = (core if mark else word).decode()
        if not text.isalpha() or max(text) > "\u024f" or "\u0130" in text:
            return None
        return self._piece(text.lower().encode()) + (self._piece(last) if mark else b"")

    def _piece(self, piece: bytes) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_VISIBLE)
            ids = self.pieces[piece] = array("I", [t.id for t in self.ask(text)]).tobytes()
        return ids

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit arrays, with END appended; a null text has END alone."""
        if len(self.seen) > self.bounds[0] or self.used > self.bounds[1]:
            self.forget()
        at = self.seen.__getitem__
        words = []
        for text in texts:
            own = (text if b"<|" in text else text.lower()).split() if text else []  # special tokens are matched before case is dropped
            words.append(np.fromiter(map(at, own), np.int64, len(own)))
        gc.disable()  # only plain values are made here, and many
        self._learn()
        gc.enable()
        return [self._gather(x) for x in words]

    def _gather(self, words: np.ndarray) -> np.ndarray:
        counts = self.count[words]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        out = np.empty(total + 1, np.uint32)
        out[:total] = self.flat[np.repeat(self.start[words] - ends + counts, counts) + np.arange(total)]
        out[total] = END
        return out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


def tokenizer(path: str, most_words: int = 700_000, most_ids: int = 16_000_000) -> WordTokenizer:
    """One for each worker process."""
    return worker_memory(("tokens", path, most_words), lambda: WordTokenizer(path, most_words, most_ids))
