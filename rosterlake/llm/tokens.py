"""Token ids by the tokenizers library, with a bounded memo of words.

The vocabulary's splitter never lets a token cross two of its words, so the ids
of a text are the ids of its words one after the other.  For texts of letters,
digits, punctuation and white space of Latin-1 a worker splits the text itself
and remembers the ids of each word it has met; new words are joined by spaces
and encoded by the library in one call (the last id of a word is one whose token
ends a word).  Any other text goes to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np

#: Words whose ids a worker remembers, at about 200 bytes each.
MEMO_WORDS = 600_000
#: Longer words are not remembered: a text that has one goes to the library whole.
MEMO_CHARS = 100

#: Characters for which splitting here equals splitting by the library.
_SPLITTABLE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's split pattern over lower-cased characters of that set.
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts as the library would encode each whole, special tokens off."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.cap = memo_words

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            block = words[at : at + 50_000]
            (ids,) = self._ids([" ".join(block)])
            cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(cuts) != len(block):
                raise AssertionError("a word did not encode to ids of its own")
            raw = ids.tobytes()
            self.memo.update(zip(block, (raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))

    def _split(self, text: str) -> list[str] | None:
        if not _SPLITTABLE.fullmatch(text) or any(s in text for s in self.special):
            return None
        return _WORDS.findall(text.lower())

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > self.cap:
            # words met first are the common ones: they stay
            self.memo = dict(itertools.islice(self.memo.items(), self.cap // 2))
        memo, split = self.memo, [self._split(t) for t in texts]
        new: set[str] = set()
        for words in split:
            if words is not None and not all(map(memo.__contains__, words)):
                new.update(w for w in words if w not in memo)
        long = {w for w in new if len(w) > MEMO_CHARS}
        self._learn(list(new - long))
        for text, words in zip(texts, split, strict=True):
            if words is None or long and not long.isdisjoint(words):
                yield self._ids([text])[0].tobytes()
            else:
                yield b"".join([memo[w] for w in words])


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process."""
    return WordEncoder(path)
