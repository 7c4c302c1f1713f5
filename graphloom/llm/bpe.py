"""Byte-level BPE of a public vocabulary file, vectorised over distinct words.

The text is cut at white space into chunks, and a chunk into words by the vocabulary's pattern. Each
distinct chunk and word is encoded once and kept in a bounded cache of the worker. New words are laid out in padded matrices of one width
class each; in every round every row merges its leftmost pair of the smallest rank, finished rows
leave the matrix and the rest lose one column. Pair ranks come from an open-addressing hash table.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

# The pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_DIR = "/opt/tokenizers"
#: No word of the pattern reaches over the start of white space that follows something else.
CHUNK = re.compile(r"\s*+\S++|\s++")
SEPARATORS = "\x1c\x1d\x1e\x1f"
NONE = np.int32(2**31 - 1)
PAD = np.int32(-1)
#: Words of more bytes than this are merged one by one, all equal pairs in a round.
WIDEST = 4096
#: Cells of one matrix.
CELLS = 1 << 18
#: Words, chunks and ids that a worker keeps before it starts anew.
CACHE_WORDS, CACHE_IDS = 300_000, 8_000_000
#: Characters above which a text's words are taken one at a time instead of as one list.
LONG_TEXT = 1_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the JSON vocabulary, as its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """(left id, right id) -> rank, by linear probing."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray):
        assert not len(left) or max(left.max(), right.max()) < 1 << 16, "ids are packed in 16 bits"
        self.keys = np.full(1 << self.BITS, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.BITS, NONE, np.int32)
        mask = (1 << self.BITS) - 1
        for rank, (key, slot) in enumerate(zip(*(x.tolist() for x in self._slots(left, right)))):
            while self.keys[slot] != 0xFFFFFFFF:
                slot = (slot + 1) & mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.uint32) << np.uint32(16)) | (right.astype(np.uint32) & np.uint32(0xFFFF))
        return key, ((key * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key, slot = self._slots(left, right)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((there != key) & (there != 0xFFFFFFFF))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (there != 0xFFFFFFFF)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Slots(dict):
    """Numbers new keys as they are asked for, and lists them in fresh."""

    def __init__(self, fresh: list[str]):
        super().__init__()
        self.fresh = fresh

    def __missing__(self, key: str) -> int:
        slot = self[key] = len(self)
        self.fresh.append(key)
        return slot


class Store:
    """Ids of the strings met so far, by slot."""

    def __init__(self):
        self.fresh: list[str] = []
        self.slot = Slots(self.fresh)
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """The ids of all that is in fresh."""
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, flat])
        self.fresh.clear()

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots in a row, and how many each has."""
        count = self.lens[slots]
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[slots] - (ends - count), count) + np.arange(total)], count


class ByteBpe:
    """A byte-level vocabulary read from `<folder>/<name>.json`."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None):
        with open(os.path.join(folder or DEFAULT_DIR, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], _byte_symbols()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.zeros(256, np.int32)
        for s, b in symbols.items():
            self.byte_ids[b] = vocab[s]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int32) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        assert len(set(self.made.tolist())) == len(self.made), "a token is made by one merge"
        self.pairs = PairTable(left, right)
        size = max(vocab.values()) + 1
        self.chars, self.inside = np.zeros(size, np.int32), np.zeros(size, bool)
        for token, i in vocab.items():
            raw = [symbols.get(c, 0) for c in token]
            self.chars[i] = sum(b & 0xC0 != 0x80 for b in raw)
            self.inside[i] = raw[0] & 0xC0 == 0x80
        self.split = regex.compile(PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.words, self.chunks = Store(), Store()

    def slots(self, text: str) -> np.ndarray:
        """The text as slots of chunks."""
        if any(c in text for c in SEPARATORS):  # white space to one of the two libraries only
            return np.array([self.chunks.slot[text]], np.int64)
        if len(text) > LONG_TEXT:
            return np.fromiter((self.chunks.slot[m.group()] for m in CHUNK.finditer(text)), np.int64)
        return np.fromiter(map(self.chunks.slot.__getitem__, CHUNK.findall(text)), np.int64)

    def settle(self) -> None:
        """Encode the chunks met since the last call, through their words."""
        if not self.chunks.fresh:
            return
        found = [[*map(self.words.slot.__getitem__, self.split.findall(c))] for c in self.chunks.fresh]
        if self.words.fresh:
            self.words.add(*self.encode_words([w.encode("utf-8", "surrogatepass") for w in self.words.fresh]))
        n = np.array([len(x) for x in found], np.int64)
        ids, lens = self.words.gather(np.array([s for x in found for s in x], np.int64))
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        self.chunks.add(ids, np.diff(total[np.concatenate([[0], np.cumsum(n)])]))

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; none for an empty or null text."""
        if max(len(self.chunks.slot), len(self.words.slot)) > CACHE_WORDS or len(self.chunks.flat) > CACHE_IDS:
            self._reset()
        found = [self.slots(t) if t else np.zeros(0, np.int64) for t in texts]
        self.settle()
        ids, lens = self.chunks.gather(np.concatenate(found) if found else np.zeros(0, np.int64))
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray | None] = [None] * len(words)
        order, at = np.argsort(size, kind="stable"), 0
        while at < len(order):
            width = int(size[order[at]])
            if width > WIDEST:
                for i in order[at:]:
                    out[i] = self._merge_long(self.byte_ids[np.frombuffer(words[i], np.uint8)])
                break
            width = max(4, 1 << (width - 1).bit_length())
            stop = min(int(np.searchsorted(size[order], width, "right")), at + max(1, CELLS // width))
            rows, at = order[at:stop], stop
            width = int(size[rows[-1]])
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            ids = np.where(np.arange(width) < size[rows, None], self.byte_ids[raw], PAD)
            for i, x in zip(rows, self._merge_rows(ids)):
                out[i] = x
        lens = np.array([len(x) for x in out], np.int32)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)).astype(np.int32), lens

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        live = np.arange(len(ids))
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            if ids.shape[1] > 1:
                at = ranks.argmin(1)
                best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
                over = best == NONE
            else:
                over = np.ones(len(ids), bool)
            if over.any():
                kept = ids[over]
                for i, row, n in zip(live[over], kept, (kept >= 0).sum(1)):
                    done[i] = row[:n]
                if over.all():
                    return done
                ids, ranks, live, at, best = (x[~over] for x in (ids, ranks, live, at, best))
            row, width = np.arange(len(ids)), ids.shape[1]
            ids[row, at] = self.made[best]
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(ids), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(ids), width - 2)
            if width > 2:
                r, a = row[at > 0], at[at > 0]
                ranks[r, a - 1] = self.pairs.find(ids[r, a - 1], ids[r, a])
                r, a = row[at < width - 2], at[at < width - 2]
                ranks[r, a] = self.pairs.find(ids[r, a], ids[r, a + 1])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """All pairs of the smallest rank at once: a token is made by one merge, so none of the pairs that arise ranks before it."""
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # runs of one token: every other pair, from the left
                first = np.concatenate([[True], np.diff(at) > 1])
                at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            ids[at] = self.made[best]
            ids = np.delete(ids, at + 1)
            at = at - np.arange(len(at))
            ranks = np.delete(ranks, at + np.arange(len(at)))
            for near in (at - 1, at):
                near = near[(near >= 0) & (near < len(ranks))]
                ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids


_LOADED: dict[tuple, ByteBpe] = {}


def load(name: str = "byte_bpe_50k", folder: str | None = None) -> ByteBpe:
    """The vocabulary, once a worker."""
    key = (name, folder)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(name, folder)
    return _LOADED[key]
