"""Token ids of whole texts by a public tokenizer, with a cache of words.

The tokenizer drops white space and its pattern never spans it, so the ids of a text are those of its
white-space-separated words in turn. Words are looked up in a bounded cache; plain Latin words that miss go
straight to the BPE model, all others through the whole tokenizer. Whole columns find their words by hash in
sorted arrays (WordTable), which compares them with the words that it holds, byte by byte.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from factloom.llm.words import Words, caches

# the pattern keeps letters and runs of these apart
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> str:
    """The printable character that byte-level BPE uses for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


class WordIds(dict):
    """word (bytes) -> its ids as little-endian unsigned integers of `dtype`."""

    def __init__(self, path: str | None = None, dtype: str = "<u4", literal_specials: bool = False, most: int = 120_000):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        self.model, self.dtype, self.most, self.letters = self.tokenizer.model, dtype, most, _byte_letters()
        self.written = [np.array([i], dtype).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        # each cache has two generations: a full one becomes the older one, whose words come back as they are met, so frequent words stay; a word is kept once its letters were met before
        self.cores: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.older_cores: dict[bytes, bytes] = {}
        self.ends: dict[bytes, bytes] = {b"": b""}

    def __missing__(self, word: bytes) -> bytes:
        ids, met = self.older.get(word), True
        if ids is None:
            ids, met = self.new(word)
        if met and len(word) < 100:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def new(self, word: bytes) -> tuple[bytes, bool]:
        """The ids of a word that no cache of words has, and whether its letters were met before."""
        core = word.rstrip(_PUNCTUATION)
        low = self._plain(core)
        if low is None:
            return self._whole(word), True
        ids, met = self.cores.get(low), True
        if ids is None:
            ids = self.older_cores.get(low)
            if ids is None:
                met, ids = False, self._bytes(self.model.tokenize(low.decode("ascii") if low.isascii() else low.decode("latin-1").translate(self.letters)))
            if len(low) < 100:
                if len(self.cores) >= self.most:
                    self.older_cores, self.cores = self.cores, {}
                self.cores[low] = ids
        return ids + self._end(word[len(core) :]) if len(core) < len(word) else ids, met

    @staticmethod
    def _plain(core: bytes) -> bytes | None:
        """Latin letters in lower case, null for all else."""
        if core.isalpha():  # of ASCII
            return core.lower()
        text = core.decode("utf-8", "replace")
        return text.lower().encode() if text.isalpha() and max(text) < "ɐ" and "İ" not in text else None

    def _end(self, end: bytes) -> bytes:
        if end not in self.ends:
            if len(self.ends) > 10_000:
                self.ends = {}
            self.ends[end] = self._whole(end)
        return self.ends[end]

    def _bytes(self, tokens: list) -> bytes:
        written = self.written
        return b"".join([written[t.id] for t in tokens])

    def _whole(self, word: bytes) -> bytes:
        return b"".join([self.written[i] for i in self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids])

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of `size`, one run after the other."""
    to = np.cumsum(size)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(first - to + size, size)


class WordTable:
    """Words and their ids in flat arrays, found by hash; at most `most` words, of which the half that fewest portions held goes when it is full."""

    def __init__(self, ids: WordIds, most: int = 1 << 19):
        self.ids, self.most = ids, most
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _keep(self, *arrays: np.ndarray) -> None:
        """hash (sorted) and slot of each word; of each slot where its bytes and its ids begin and how many portions held it."""
        self.hash, self.slot, self.first, self.bytes, self.at, self.tokens, self.uses = arrays

    def _halved(self) -> None:
        order = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        kept = np.isin(self.slot, order)
        slots = self.slot[kept]
        sizes, counts = (self.first[slots + 1] - self.first[slots]), (self.at[slots + 1] - self.at[slots])
        body, tokens = self.bytes[_ragged(self.first[slots], sizes)], self.tokens[_ragged(self.at[slots], counts)]
        self._keep(self.hash[kept], np.arange(len(slots)), np.append(0, np.cumsum(sizes)), body, np.append(0, np.cumsum(counts)), tokens, self.uses[slots] // 2)

    def _added(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """hashes: sorted, none of them here yet."""
        if len(self.hash) + len(words) > self.most:
            self._halved()
        made = [self.ids.new(w)[0] for w in words]
        n, place = len(self.uses), np.searchsorted(self.hash, hashes)
        self.hash, self.slot = np.insert(self.hash, place, hashes), np.insert(self.slot, place, np.arange(n, n + len(words)))
        self.first = np.append(self.first, self.first[-1] + np.cumsum([len(w) for w in words]))
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(x) // 4 for x in made]))
        self.bytes = np.append(self.bytes, np.frombuffer(b"".join(words), np.uint8))
        self.tokens = np.append(self.tokens, np.frombuffer(b"".join(made), "<u4"))
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, and whether there is one."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return self.slot[place], self.hash[place] == hashes

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one row after the other, and where each row's begin (one more than rows)."""
        words = Words(column)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(words.rows + 1, np.int64)
        data, start, size = words.data.tobytes(), words.start, words.end - words.start
        hashes, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
        _, there = self._slots(hashes)
        new = np.flatnonzero(~there)
        for part in np.array_split(new, -(-len(new) // max(self.most // 2, 1))) if len(new) else ():
            self._added(hashes[part], [data[a:b] for a, b in zip(start[one[part]].tolist(), words.end[one[part]].tolist(), strict=True)])
        slots, there = self._slots(hashes)
        self.uses[slots[there]] += 1
        slot, known = slots[which], there[which]
        # words of one hash are the same only if their bytes are
        known &= self.first[slot + 1] - self.first[slot] == size
        mine, where = size[known], np.flatnonzero(known)
        differ = self.bytes[_ragged(self.first[slot[known]], mine)] != words.data[_ragged(start[known], mine)]
        if differ.any():
            known[where[np.repeat(np.arange(len(where)), mine)[differ]]] = False
        counts = np.where(known, self.at[slot + 1] - self.at[slot], 0)
        others = {i: np.frombuffer(self.ids.new(data[start[i] : words.end[i]])[0], "<u4") for i in np.flatnonzero(~known).tolist()}
        for i, ids in others.items():
            counts[i] = len(ids)
        to = np.append(0, np.cumsum(counts))
        if not others:
            return self.tokens[_ragged(self.at[slot], counts)], to[words.first]
        out = np.zeros(to[-1], np.uint32)
        out[np.repeat(known, counts)] = self.tokens[_ragged(self.at[slot[known]], counts[known])]
        for i, ids in others.items():
            out[to[i] : to[i + 1]] = ids
        return out, to[words.first]


@functools.cache
def word_ids(path: str | None, dtype: str = "<u4", literal_specials: bool = False) -> WordIds:
    """One cache for all the tasks that a Python worker runs."""
    return WordIds(path, dtype, literal_specials)


@functools.cache
def word_table(path: str | None) -> WordTable:
    """Likewise, for whole columns."""
    return WordTable(WordIds(path))


caches["word_ids"] = word_ids.cache_clear
caches["word_table"] = word_table.cache_clear
