"""BPE encoding and decoding in numpy merge rounds.

``Vocabulary`` reads a tokenizer file whose splitter yields words, whose symbols
are bytes and whose last symbol of a word carries an end mark.  ``encode_words``
puts the symbols of many words in one flat array.  A round looks all adjacent
pairs up by binary search in the sorted pair keys, takes the lowest rank of each
word and merges it, until no word has a known pair left.  Words are remembered,
so a round works on what the texts of a batch bring that is new.  Rounds grow with the
length of a word, so one of over ``LONG`` symbols has its pairs looked up in the same way
and then merges them one by one from a queue, lowest rank and leftmost first.

A pair merges at all its places in a word at once, left to right.  That equals
merging one place at a time if no merge that uses a token ranks before the merge
that makes it; ``Vocabulary`` checks this and otherwise merges the leftmost place
only.

Defined cases: null text is the empty text, with no ids and an empty decoded
text; a text of any length is encoded whole; repeated rows stay; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches

NONE = np.int64(1) << 62
#: Words that a worker remembers, at about 200 bytes each; longer words are not.
MEMO_WORDS, MEMO_CHARS = 600_000, 100
#: Symbols merged in one flat array at most, but for one longer word.
FLAT_SYMBOLS = 1 << 20
#: Symbols of a word that is merged from a queue.
LONG = 512

# Letters of Unicode 16, which the library's splitter knows and Python's
# unicodedata does not, in ranges; capitals of Unicode 16 and 17, which its lower-casing
# knows, by their distance to the small letter.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]

ENCODED = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the
    next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


@functools.cache
def later_letters() -> tuple[frozenset[str], dict[str, str]]:
    """The later letters that this Python does not know, and the small letter of each
    later capital."""
    known = lambda c: unicodedata.category(c) != "Cn"
    letters = frozenset(chr(i) for lo, hi in LATER_LETTERS for i in range(lo, hi + 1) if not known(chr(i)))
    return letters, {chr(i): chr(i + by) for lo, hi, by in LATER_CAPITALS for i in range(lo, hi + 1) if not known(chr(i))}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end_mark = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["decoder"] is not None or not self.end_mark:
            raise ValueError("this reads vocabularies with an end mark and no decoder")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end_mark] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        key, rank = left * size + right, np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.ranks, self.made = size, key[order], rank[order], made[order]
        maker = np.full(size, -1, np.int64)
        maker[made] = rank  # the last merge that makes a token
        self.all_at_once = bool(((maker[left] < rank) & (maker[right] < rank)).all())
        text = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            text[i] = token
        self.text = text
        self.memo: dict[str, bytes] = {}

    # -- text to words

    def words(self, text: str) -> list[str | int]:
        """Words, and ids where the text has a special token."""
        if not tokens._SPLITTABLE.fullmatch(text) or (self.cut_special and self.cut_special.search(text)):
            out: list[str | int] = []
            for part in self.cut_special.split(text) if self.cut_special else [text]:
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    letters, small = later_letters()
                    part = "".join([small.get(c) or c.lower() for c in unicodedata.normalize("NFC", part)])
                    # what no table had when the library was made is no letter there
                    seen = "".join(["a" if c in letters else "\ue000" if unicodedata.category(c) == "Cn" else c for c in part])
                    out += [part[m.start() : m.end()] for m in self.pattern.finditer(seen)]
            return out
        return tokens._WORDS.findall(text.lower())

    # -- words to ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word (none may be empty)."""
        out: list[bytes] = []
        held: list[bytes] = []
        weight = 0
        for word in words:
            raw = word.encode()
            if len(raw) > LONG:
                out += [*(self._merge(held) if held else []), self._merge_long(raw)]
                held, weight = [], 0
                continue
            if held and weight + len(raw) > FLAT_SYMBOLS:
                out += self._merge(held)
                held, weight = [], 0
            held.append(raw)
            weight += len(raw)
        return out + (self._merge(held) if held else [])

    def _merge(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            if len(symbols) == 1:
                pair, found = np.zeros(0, np.int64), np.zeros(0, bool)
                ranks = np.full(1, NONE)
            else:
                key = symbols[:-1] * self.size + symbols[1:]
                pair = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = (self.keys[pair] == key) & (word[:-1] == word[1:])
                ranks = np.append(np.where(found, self.ranks[pair], NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = np.repeat(best == NONE, sizes)
            if over.any():  # words without a known pair leave
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
                pair = np.append(pair, 0)[keep]
                best, sizes = best[best != NONE], sizes[best != NONE]
                if not len(symbols):
                    break
            else:
                pair = np.append(pair, 0)
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            if self.all_at_once:  # of adjoining places, as in "aaa", every other one
                gap = np.append(True, np.diff(at) > 1)
                run_start = at[np.flatnonzero(gap)][np.cumsum(gap) - 1]
                at = at[(at - run_start) % 2 == 0]
            else:
                at = at[np.append(True, word[at][1:] != word[at][:-1])]
            symbols[at] = self.made[pair[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        raw = symbols[order].astype("<u4").tobytes()
        cuts = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _merge_long(self, word: bytes) -> bytes:
        """The same for one long word, in time of n log n."""
        flat = np.frombuffer(word, np.uint8)
        start = np.append(self.inner[flat[:-1]], self.last[flat[-1]])
        key = start[:-1] * self.size + start[1:]
        pair = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ranks = np.where(self.keys[pair] == key, self.ranks[pair], -1)
        n, size, known = len(start), self.size, self.known
        symbols, rank = start.tolist(), [*ranks.tolist(), -1]  # of the pair that begins there
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        at = np.flatnonzero(ranks >= 0)
        queue = (ranks[at] * n + at).tolist()
        heapq.heapify(queue)

        def changed(i: int, j: int) -> None:
            found = known.get(symbols[i] * size + symbols[j])
            rank[i] = -1 if found is None else found[0]
            if found is not None:
                heapq.heappush(queue, found[0] * n + i)

        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            if rank[i] != r:
                continue  # one of its symbols has gone into another
            j = after[i]
            k, h = after[j], before[i]
            symbols[i] = known[symbols[i] * size + symbols[j]][1]
            rank[i] = rank[j] = symbols[j] = -1
            after[i] = k
            if k >= 0:
                before[k] = i
                changed(i, k)
            if h >= 0:
                changed(h, i)
        out = np.array(symbols, np.int64)
        return out[out >= 0].astype("<u4").tobytes()

    @functools.cached_property
    def known(self) -> dict[int, tuple[int, int]]:
        """Rank and made token of each pair."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        split = [self.words(t) for t in texts]
        memo = self.memo
        new = [w for w in set().union(*split).difference(memo) if isinstance(w, str)]
        ids = self.encode_words(new)
        long = {w: i for w, i in zip(new, ids, strict=True) if len(w) > MEMO_CHARS}
        memo.update((w, i) for w, i in zip(new, ids, strict=True) if len(w) <= MEMO_CHARS)
        special = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        out = []
        for ws in split:
            try:
                out.append(b"".join([memo[w] for w in ws]))
            except KeyError:
                out.append(b"".join([memo.get(w) or long.get(w) or special[w] for w in ws]))
        return out

    # -- ids to text

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between, as a vocabulary without a decoder
        has it; ids that it lacks are left out."""
        wanted = np.frombuffer(ids, "<u4")
        if len(wanted) and int(wanted.max()) >= self.size:
            wanted = wanted[wanted < self.size]
        return " ".join(map(self.text.__getitem__, wanted.tolist()))

    def restore(self, ids: bytes) -> str:
        """The lower-cased words themselves, a space after each."""
        letters = {c: b for b, c in enumerate(byte_letters())}
        out = bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            token = self.text[i]
            if token in self.special:
                out += token.encode() + b" "
                continue
            ends = token.endswith(self.end_mark) and token != self.end_mark
            out += bytes(letters[c] for c in (token[: -len(self.end_mark)] if ends else token)) + b" " * ends
        return out.decode("utf-8", "replace").rstrip(" ")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for a worker process."""
    return Vocabulary(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document's whole text."""
    path = tokenizer or tokens.default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
            for lo in range(0, len(ids), 128):
                part = ids[lo : lo + 128]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array([len(i) // 4 for i in part], pa.int64()), pa.array(part, pa.binary()), pa.array([vocab.decode(i) for i in part], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, ENCODED)
