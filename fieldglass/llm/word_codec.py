"""Token ids of texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import json
import os

import numpy as np

#: Bytes of texts that are cut into words together, and words that are remembered.
PIECE = 1 << 22
REMEMBERED = 1 << 20
#: Pre-tokenizer's pattern under which ASCII words fall into runs of letters, single digits and runs of other signs.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of at most so many bytes is told by three 64-bit numbers: its bytes, and its length in the last byte.
SHORT = 23
#: Short words that go to the library as one text.
JOINED = 64

_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _WHOLE
_CLASS[[ord("'"), ord("<")]] = _WHOLE  # may begin a contraction or a special token
#: Latin letters with accents are two bytes in UTF-8: this one and any from 0x80 but the signs of multiplication and division; capitals stand 32 before small ones.
_LATIN = 0xC3
_ACCENTED = np.zeros(256, bool)
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordCodec:
    """Ids of whole texts, as the tokenizer gives them without special tokens added.

    A tokenizer that drops white space and knows no context beyond it gives a
    text the ids of its words, one after the other. Words of ASCII and
    accented Latin letters without apostrophes are cut further, into the runs that the pre-tokenizer makes,
    and lower-cased. What is left is looked up in a table by its bytes; the
    library is asked once for each entry. A tokenizer of any other kind encodes
    whole texts.
    """

    _held: tuple[str, WordCodec] | None = None

    @classmethod
    def of(cls, path: str) -> WordCodec:
        """The codec of a file, kept in the worker from task to task."""
        if cls._held is None or cls._held[0] != path:
            cls._held = (path, cls(path))
        return cls._held[1]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = lambda part, name: [(x["type"], x.get("pattern", {}).get("Regex"), x.get("behavior"), x.get("invert")) for x in (made[part] or {}).get(name, [])]
        self.suffix = made["model"].get("end_of_word_suffix")
        self.by_word = bool(self.suffix) and steps("pre_tokenizer", "pretokenizers")[:1] == [("Split", RUNS, "Removed", True)] and [x[:2] for x in steps("normalizer", "normalizers")] == [
            ("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and not any(x["lstrip"] or x["rstrip"] or x["normalized"] for x in made["added_tokens"])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.suffix:
            self.last[[i for w, i in vocabulary.items() if w.endswith(self.suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.size = 0
        self.bits = (2 * REMEMBERED).bit_length() - 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((3, REMEMBERED), np.uint64)
        self.first = np.zeros(REMEMBERED + 1, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (key[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (key[1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (key[2] * np.uint64(0xD6E8FEB86659FD93))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot, found = self._slot(key), np.full(key.shape[1], -1, np.int32)
        todo = np.arange(key.shape[1])
        while len(todo):
            entry = self.slots[slot[todo]]
            todo, entry = todo[entry >= 0], entry[entry >= 0]
            same = (self.keys[0, entry] == key[0, todo]) & (self.keys[1, entry] == key[1, todo]) & (self.keys[2, entry] == key[2, todo])
            found[todo[same]] = entry[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return found

    def _learn(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New entries for keys that differ."""
        n, at = key.shape[1], self.size
        entry, slot, todo = np.arange(at, at + n, dtype=np.int32), self._slot(key), np.arange(n)
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = entry[free]
            todo = todo[self.slots[slot[todo]] != entry[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.keys[:, at : at + n] = key
        self.first[at + 1 : at + n + 1] = self.first[at] + np.cumsum(count)
        end = int(self.first[at + n])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.first[at]], np.zeros(end, np.uint32)])
        self.ids[self.first[at] : end] = ids
        self.size += n

    def _asked(self, words: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words, and how many each has; of runs that one text can hold, each ends with the only token that ends a word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        blocks = [" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)] if joined else texts
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        if not joined:
            return ids, np.array([len(x) for x in found], np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._asked(words, False)

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs, whether one is part of a plain word, and the ends of words; ``data`` has lower-cased plain words afterwards."""
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == _LATIN)
        accented = lead[_ACCENTED[data[lead + 1]]]
        kind[accented] = kind[accented + 1] = _LETTER
        solid = kind != _SPACE
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        odd = np.flatnonzero(kind == _WHOLE)
        plain = np.ones(len(start), bool)
        plain[np.searchsorted(start, odd, "right") - 1] = False
        mark = np.zeros(len(data) + 1, np.int8)
        np.add.at(mark, start[~plain], 1)
        np.add.at(mark, end[~plain], -1)
        whole = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        np.copyto(data, _LOWER[data], where=~whole)
        capital = accented[~whole[accented] & (data[accented + 1] <= 0x9E)] + 1
        data[capital] += 32
        first = solid.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first &= ~whole
        first[start] = True
        begin = np.flatnonzero(first)
        of = np.searchsorted(start, begin, "right") - 1
        stop = np.minimum(np.concatenate([begin[1:], [len(data)]]), end[of]) if len(begin) else begin
        return begin, stop, plain[of] if len(begin) else np.zeros(0, bool), end

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, starts of its runs in bytes, ids before each run (and all), and ids at the ends of its sentences.

        A sentence ends with ``.``, ``!`` or ``?`` before white space, or with its line.
        """
        data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(32, np.uint8)])
        data[len(raw) :] = 32
        begin, stop, plain, word_end = self._words(data)
        size = stop - begin
        short = size <= SHORT
        lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        key = np.stack([lanes[begin + 8 * i] & _LOW_BYTES[np.clip(size - 8 * i, 0, 8)] for i in range(3)])
        with np.errstate(over="ignore"):
            key[2] |= size.astype(np.uint64) << np.uint64(56)
        code = np.full(len(begin), -1, np.int32)
        code[short] = self._find(key[:, short])
        miss = np.flatnonzero((code < 0) & short)
        raw_words = data.tobytes()
        words = lambda of: [raw_words[a:b] for a, b in zip(begin[of].tolist(), stop[of].tolist())]
        if len(miss):
            order = miss[np.lexsort(key[:, miss])]
            fresh = np.concatenate([[True], (key[:, order[1:]] != key[:, order[:-1]]).any(axis=0)])
            new = order[fresh]
            if self.size + len(new) > REMEMBERED:
                if len(new) > REMEMBERED or not self.size:
                    raise ValueError("a piece of text holds more words than can be remembered")
                self._forget()
                return self.encode(raw)
            for joined in (True, False):
                some = new[plain[new] == joined]
                if len(some):
                    self._learn(key[:, some], *self._asked(words(some), joined))
            code[miss] = self._find(key[:, miss])
        count = np.zeros(len(begin), np.int64)
        count[short] = self.first[code[short] + 1] - self.first[code[short]]
        long = np.flatnonzero(~short)
        apart, count[long] = self._asked(words(long), False)
        before = np.concatenate([[0], np.cumsum(count)])
        from_ = np.zeros(len(begin), np.int64)
        from_[short] = self.first[code[short]]
        source = np.repeat(from_ - before[:-1], count) + np.arange(before[-1])
        ids = self.ids[np.clip(source, 0, len(self.ids) - 1)]
        if len(long):
            there = np.concatenate([np.arange(before[i], before[i + 1]) for i in long])
            ids[there] = apart
        ends = word_end[_STOP[data[word_end - 1]] | (data[word_end] == 10)]
        return ids, begin, before, before[np.searchsorted(begin, ends)]

    def _whole_text(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = raw.decode("utf-8", "replace")
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ends = np.array([b for _, b in found.offsets], np.int64)
        stops = [i + 1 for i, c in enumerate(text) if c == "\n" or c in ".!?" and text[i + 1 : i + 2].isspace()]
        return np.array(found.ids, np.uint32), np.unique(np.searchsorted(ends, stops, "right"))

    def documents(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and how many ids stand before the end of each sentence."""
        if not self.by_word:
            return [self._whole_text(t) for t in texts]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        block: list[bytes] = []
        held = 0
        for t in texts:
            if len(t) > PIECE:
                out += self._block(block)
                out.append(self._long(t))
                block, held = [], 0
                continue
            block.append(t)
            held += len(t)
            if held >= PIECE:
                out += self._block(block)
                block, held = [], 0
        return out + self._block(block)

    def _block(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not texts:
            return []
        ids, begin, before, ends = self.encode(b"\n".join(texts))
        edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        at = before[np.searchsorted(begin, edge)]
        cut = np.searchsorted(ends, at)
        return [(ids[a:b], ends[c:d] - a) for a, b, c, d in zip(at[:-1], at[1:], cut[:-1], cut[1:])]

    def _long(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A long text in pieces that are cut at white space."""
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        at = total = 0
        while at < len(text):
            to = min(at + PIECE, len(text))
            while to < len(text) and _CLASS[text[to]] != _SPACE:
                to += 1
            found, _, _, stops = self.encode(text[at:to])
            ids.append(found)
            ends.append(stops + total)
            at, total = to, total + len(found)
        return np.concatenate(ids), np.concatenate(ends)
