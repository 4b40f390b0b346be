"""Token ids by a public tokenizer, with a word cache in each Python worker.

A tokenizer that cuts at white space gives the same ids word by word, so each worker keeps the ids of the words it
has met (at most MAX_WORDS, then it starts anew) and only new words reach the tokenizers library.
"""

from __future__ import annotations

import re

import numpy as np

MAX_WORDS = 700_000
BLOCK_CHARS = 2_000_000
_NOT_LATIN = re.compile("[^\x00-į]")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for Python, not for the tokenizer
_TAIL = ",.;:!?"


class WordEncoder:
    """ids of whole texts as little-endian uint32 bytes."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.max_words = max_words
        self.cache: dict[str, bytes] = {}
        size = self.tok.get_vocab_size()
        self.vocab = size
        self.ends = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        probe = self._raw(["ab cd", "ab,", "AB", "ab", "cd", ","])
        self.by_word = probe[0] == probe[3] + probe[4] and probe[1] == probe[3] + probe[5]
        self.folds = probe[2] == probe[3]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str]:
        if not self.by_word or _ODD_SPACE.search(text):
            return [text]
        if self.folds and "<|" not in text and (text.isascii() or not _NOT_LATIN.search(text)):
            text = text.lower()
        return text.split()

    def _learn(self, new: set[str]) -> None:
        cache = self.cache
        stems, alone, joined = set(), [], []
        for w in new:
            if not w.isascii() and _NOT_LATIN.search(w):  # what case folding makes of other letters may join with their neighbours
                alone.append(w)
            elif w.isalpha():
                stems.add(w)
            elif self.by_word and len(w) > 1 and w[-1] in _TAIL and w[:-1].isalpha():
                joined.append(w)
                stems.add(w[:-1])
                stems.add(w[-1])
            else:
                alone.append(w)
        stems = [w for w in stems if w not in cache]
        plain = [w for w in stems if w.isalpha()]
        alone += [w for w in stems if not w.isalpha()]
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and len(part):
                data, cuts = ids.tobytes(), (cuts * 4).tolist()
                cache.update(zip(part, (data[a:b] for a, b in zip([0, *cuts], cuts))))
            else:
                alone += part
        if alone:
            cache.update(zip(alone, self._raw(alone)))
        for w in joined:
            cache[w] = cache[w[:-1]] + cache[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            if text and len(text) > BLOCK_CHARS and self.by_word:
                out += self._block(block)
                block, chars = [], 0
                out.append(b"".join(b for part in self._parts(text) for b in self._block([self._words(part)])))
                continue
            block.append(self._words(text) if text else [])
            chars += len(text or "")
            if chars > BLOCK_CHARS:
                out += self._block(block)
                block, chars = [], 0
        return out + self._block(block)

    @staticmethod
    def _parts(text: str):
        at = 0
        space = re.compile(r"\s")
        while at < len(text):
            m = space.search(text, at + BLOCK_CHARS) if at + BLOCK_CHARS < len(text) else None
            to = m.end() if m else len(text)
            yield text[at:to]
            at = to

    def _block(self, block: list[list[str]]) -> list[bytes]:
        if len(self.cache) > self.max_words:
            self.cache.clear()
        get = self.cache.get
        got, new, late = [], set(), []
        for i, words in enumerate(block):
            ids = list(map(get, words))
            if None in ids:
                new.update(w for w, x in zip(words, ids) if x is None)
                late.append(i)
                got.append(b"")
            else:
                got.append(b"".join(ids))
        if new:
            self._learn(new)
            for i in late:
                got[i] = b"".join(map(self.cache.__getitem__, block[i]))
        return got


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, max_words: int = MAX_WORDS) -> WordEncoder:
    """One for each worker process and tokenizer file; max_words is that of the last call."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].max_words = max_words
    return _ENCODERS[path]
