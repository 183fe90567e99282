"""Ids of whole texts by a public tokenizer, with a bounded memory of pieces.

Both tokenizers here break a text before a space that follows anything but a space, and between an ASCII letter or
digit and an ASCII sign other than an apostrophe; so the ids of a text are the ids of such pieces put together. Each
distinct piece is encoded once by the tokenizers library and remembered under two 64-bit hashes of its bytes in a
table of fixed size with two places for each, where a new piece may take the place of an old one. Texts for which the rule doesn't hold (runs of
spaces or a space at the end under a byte-level vocabulary, spelled special tokens) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textbytes import LOWER, Rolling, text_bytes

MARK = "<|endoftext|>"  # a token of its own in both vocabularies
WIDE = 8  # ids of a piece that is remembered, at most
LETTER, SIGN = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[33:127] = SIGN
KIND[[c for c in range(128) if chr(c).isalnum()]] = LETTER
KIND[ord("'")] = 0


class PieceEncoder:
    """encode(column) -> (ids end to end, counts). slots: pieces remembered at most, some 50 bytes each."""

    def __init__(self, path: str, spaces_matter: bool, slots: int = 1 << 20):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.spaces_matter, self.slots = Tokenizer.from_file(path), spaces_matter, slots
        self.mark = self.tokenizer.token_to_id(MARK)
        self.one, self.two = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size = np.zeros(slots, np.int64)
        self.pool = np.zeros(slots * WIDE + (1 << 16), np.uint32)  # WIDE ids a slot, then those of a slice's new pieces

    def _slots(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two places where a piece may be."""
        return (one % np.uint64(self.slots)).astype(np.int64), (two % np.uint64(self.slots)).astype(np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, said: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, counts) of pieces. Many are encoded in one call, with the end-of-text token between them as a
        mark: the tokenizer takes what stands between such tokens by itself."""
        joined = [MARK.join(said[k : k + 500]) for k in range(0, len(said), 500)]
        ids = np.concatenate([np.array([*e.ids, self.mark], np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        mark = ids == self.mark
        return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def _learned(self, data: bytes, start: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of pieces that aren't remembered; from now on they are."""
        _, first, back = np.unique(one, return_index=True, return_inverse=True)
        start, end, one, two = start[first], end[first], one[first], two[first]
        parts = [self._encoded([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[k : k + 20_000].tolist(), end[k : k + 20_000].tolist(), strict=True)]) for k in range(0, len(start), 20_000)]
        ids, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = self.slots * WIDE + np.cumsum(size) - size
        if len(self.pool) < self.slots * WIDE + len(ids):
            self.pool = np.concatenate([self.pool[: self.slots * WIDE], np.zeros(2 * len(ids), np.uint32)])
        self.pool[self.slots * WIDE : self.slots * WIDE + len(ids)] = ids
        slot, other = self._slots(one, two)
        slot = np.where(self.one[slot] == 0, slot, other)
        _, last = np.unique(slot[::-1], return_index=True)
        keep = len(slot) - 1 - last
        keep = keep[size[keep] <= WIDE]
        s, n = slot[keep], size[keep]
        self.one[s], self.two[s], self.size[s] = one[keep], two[keep], n
        inside = np.arange(WIDE)[None, :] < n[:, None]
        rows = np.zeros((len(s), WIDE), np.uint32)
        rows[inside] = ids[np.repeat(place[keep] - self.slots * WIDE - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        self.pool[: self.slots * WIDE].reshape(-1, WIDE)[s] = rows
        return place[back], size[back]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """column: texts without nulls, a few MB of them."""
        raw, offsets = text_bytes(column)
        data = raw if self.spaces_matter else LOWER[raw]  # such a vocabulary lowers case
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        kind, space = KIND[data], data == 32
        fresh = np.zeros(n, bool)
        fresh[1:] = (space[1:] & ~space[:-1]) | (kind[1:] | kind[:-1] == LETTER | SIGN)
        fresh[offsets[:-1][np.diff(offsets) > 0]] = True
        odd = data == ord("<")
        odd[:-1] &= data[1:] == ord("|")
        if self.spaces_matter:
            odd[:-1] |= space[:-1] & space[1:]
            last = offsets[1:][np.diff(offsets) > 0] - 1
            odd[last] |= space[last]
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], n)
        text = np.searchsorted(offsets, start, "right") - 1
        if len(odd):
            plain = ~np.isin(text, odd)
            start, end, text = start[plain], end[plain], text[plain]
        if not self.spaces_matter:
            start = start + space[start]
        one = np.maximum(Rolling(data).hash(start, end), np.uint64(1))  # 0 is an empty slot
        two = Rolling(data, 1).hash(start, end)
        slot, other = self._slots(one, two)
        known = (self.one[slot] == one) & (self.two[slot] == two)
        rest = np.flatnonzero(~known)
        slot[rest] = other[rest]
        known[rest] = (self.one[slot[rest]] == one[rest]) & (self.two[slot[rest]] == two[rest])
        place, size = slot * WIDE, self.size[slot]
        if not known.all():
            new = np.flatnonzero(~known)
            at, many = place[known], size[known]
            held = self.pool[np.repeat(at - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]  # before slots change hands
            place[new], size[new] = self._learned(data.tobytes(), start[new], end[new], one[new], two[new])
            ids = np.zeros(int(size.sum()), np.uint32)
            old = np.repeat(known, size)
            ids[old] = held
            at, many = place[new], size[new]
            ids[~old] = self.pool[np.repeat(at - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        else:
            ids = self.pool[np.repeat(place - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        counts = np.bincount(text, weights=size, minlength=len(column)).astype(np.int64)
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in odd.tolist():
                parts[k] = self.whole(column[k].as_py())
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, counts


_KEPT: dict[tuple, PieceEncoder] = {}


def encoder(path: str, spaces_matter: bool) -> PieceEncoder:
    """One encoder per worker process and file."""
    if (path, spaces_matter) not in _KEPT:
        _KEPT[path, spaces_matter] = PieceEncoder(path, spaces_matter)
    return _KEPT[path, spaces_matter]


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer's file: in `folder`, or of the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
