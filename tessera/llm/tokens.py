"""Token ids of whole texts, made by the tokenizers library.

The vocabularies used here drop white space and never join across it, and their
normalisers act within a word, so the ids of a text are the ids of its words in turn.
Each task therefore asks the library once for every distinct word it meets and joins
the stored ids; a bounded store keeps the words met first, the frequent ones among them.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Bytes of words and their ids kept per Python worker, about, and the longest word kept.
STORED_BYTES = 112 << 20
LONGEST_STORED = 64
#: What Python's own objects take for a word besides its characters and ids.
_OVERHEAD = 190
#: A character that is a token of its own between spaces; words that hold it go alone.
MARK = "\x01"
#: Characters that str.split takes for white space and Unicode does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Unicode white space.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters of new words sent to the library at once; its time a word grows with their number.
_AT_ONCE = 1 << 13

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """ids(text) for one tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stored: dict[str, bytes] = {}
        self.room = STORED_BYTES
        # Where the library lowers case anyway, A-Z are lowered first: fewer different words.
        self.lowers = '"type":"Lowercase"' in self.tokenizer.to_str()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self._alone(MARK)
        if len(mark) != 4:
            raise ValueError(f"{path} has no single token for the mark between words")
        self.mark = int(np.frombuffer(mark, "<u4")[0])

    @staticmethod
    def of(path: str) -> WordEncoder:
        """One encoder per worker process and file."""
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def _alone(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        joined = np.asarray(self.tokenizer.encode(f" {MARK} ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(joined == self.mark)
        raw, lo = joined.tobytes(), 0
        for word, hi in zip(words, [*(4 * ends).tolist(), len(raw)], strict=True):
            into[word] = raw[lo:hi]
            lo = hi + 4

    def _lowered(self, text: str) -> str:
        """``text`` with A-Z lowered, unless that could change its ids or make a special token."""
        if not self.lowers:
            return text
        low = text.encode().lower().decode()
        return text if any(s in low for s in self.special) else low

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null, empty or blank ones."""
        texts = [self._lowered(t) if t else "" for t in texts]
        split = [[w for w in _SPACE.split(t) if w] if _NOT_SPACE.search(t) else t.split() for t in texts]
        stored, fresh = self.stored, {}
        missing: set[str] = set()
        for words in split:
            missing.update(set(words).difference(stored))
        batch, size = [], 0
        for word in missing:
            if MARK in word or len(word) > LONGEST_STORED:
                fresh[word] = self._alone(word)
                continue
            batch.append(word)
            size += len(word)
            if size > _AT_ONCE:
                self._learn(batch, fresh)
                batch, size = [], 0
        if batch:
            self._learn(batch, fresh)
        stored.update(fresh)
        out = [b"".join(map(stored.__getitem__, words)) for words in split]
        for word, ids in fresh.items():
            if self.room > 0 and len(word) <= LONGEST_STORED:
                self.room -= len(word) + len(ids) + _OVERHEAD
            else:
                del stored[word]
        return out
