"""Exact, cached use of the tokenizers library over batches of documents.

A text is cut at places where the tokenizer's own pre-tokenizer always cuts (a letter run next to
punctuation or digits, a single blank between two visible ASCII or Latin-1 characters), equal pieces
(by their bytes) are encoded once a worker, and ids are put together again with numpy. Where a cut might
not be safe (apostrophes, other scripts, runs of white space) the piece simply stays longer. A document
longer than ``LONG`` is worked off in parts that begin at such a cut; one that holds a special token's
string is encoded in one go.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa

from . import textkit as K

#: pieces a worker remembers at most; beyond, it starts anew
REMEMBER = 400_000
#: bytes of a document that are in work at once
LONG = 2 << 20
_LETTER, _DIGIT, _PUNCT, _QUOTE, _BLANK, _BREAK = 1, 2, 3, 4, 5, 6
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _PUNCT
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("'")] = _QUOTE
_KIND[0x20] = _BLANK
_KIND[0x09:0x0E] = _BREAK


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole documents; ``by_word``: the tokenizer lower-cases and drops white space."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.model, self.table = self.tokenizer.model, _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each piece; kind of each byte."""
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        left, right = np.zeros_like(kind), np.zeros_like(kind)
        left[1:], right[:-1] = kind[:-1], kind[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        left[inner] = 0
        right[inner - 1] = 0
        seen, seen_left, seen_right = ((x >= _LETTER) & (x <= _QUOTE) for x in (kind, left, right))
        solid = lambda x: (x >= _LETTER) & (x <= _PUNCT)
        cut = solid(kind) & solid(left) & (kind != left)
        if self.by_word:
            white = kind >= _BLANK
            cut |= white != (left >= _BLANK)
        else:
            alone = (kind >= _BLANK) & seen_left & seen_right
            cut |= alone
            after = alone & (kind == _BREAK)
            cut[1:] |= after[:-1] & seen[1:]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(cut), kind

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another; ids before each document (and in all)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes() if any(data.tobytes().find(s) >= 0 for s in self.special) else None
        if raw is not None:
            rows = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if len(rows) == 1:
                ids = np.array(self._whole([rows[0].decode()])[0], np.int32)
                return ids, np.array([0, len(ids)], np.int64)
            parts = [self.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in rows]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        if len(offsets) == 2 and len(data) > LONG:
            parts = [self._pieces(data[a:b], np.array([0, b - a]))[0] for a, b in self._parts(data)]
            return np.concatenate(parts), np.array([0, sum(map(len, parts))], np.int64)
        return self._pieces(data, offsets)

    def _parts(self, data: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a text that begin at a blank between two ASCII letters: a cut for either tokenizer."""
        bounds = [0]
        while bounds[-1] + LONG < len(data):
            at = bounds[-1] + LONG
            while at < len(data) - 1:
                near = data[at - 1 : at + LONG + 1]
                letter = (_KIND[near] == _LETTER) & (near < 0x80)
                here = np.flatnonzero(letter[:-2] & (near[1:-1] == 0x20) & letter[2:])
                if len(here):
                    at += int(here[0])
                    break
                at += LONG
            if at >= len(data) - 1:
                break
            bounds.append(at)
        return list(zip(bounds, [*bounds[1:], len(data)], strict=True))

    def _alike(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A piece of each kind, and the kind of each piece; pieces of a kind have the same bytes."""
        place, kinds = pd.factorize(K.piece_hashes(data, starts, sizes)[0])
        first = np.empty(len(kinds), np.int64)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        head = first[place]
        if (sizes == sizes[head]).all() and K.equal_pieces(data, starts, starts[head], sizes):
            return first, place
        raw, known = data.tobytes(), {}
        place = np.array([known.setdefault(raw[a : a + n], len(known)) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        return np.unique(place, return_index=True)[1], place

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.by_word:
            data = K.LOWER[data]
        starts, kind = self._cuts(data, offsets)
        sizes = np.diff(starts, append=len(data))
        first, place = self._alike(data, starts, sizes)
        if len(self.known) > REMEMBER:
            self._forget()
        raw = data.tobytes()
        keys = [raw[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)]
        known = self.known
        numbers = [known.get(k, -1) for k in keys]
        new = [i for i, n in enumerate(numbers) if n < 0]
        if new:
            letters = np.concatenate(([0], np.cumsum(kind == _LETTER)))
            at, size = starts[first[new]], sizes[first[new]]
            inside = letters[at + size] - letters[at]
            blank = (kind[at] == _BLANK) & (not self.by_word)
            plain = (inside > 0) & (inside == size - blank)
            void = (kind[at] >= _BLANK) & self.by_word
            pieces = [keys[i] for i in new]
            rest = iter(self._whole([p.decode() for p, q, v in zip(pieces, plain, void, strict=True) if not (q or v)]))
            tokenize, table, by_word, added, behind = self.model.tokenize, self.table, self.by_word, [], []
            number, total, mark = len(self.ends) - 1, len(self.flat), table[0x20]
            for i, piece, easy, empty in zip(new, pieces, plain.tolist(), void.tolist(), strict=True):
                if easy:
                    if by_word:
                        piece = piece.decode().lower().encode()
                    if piece.isascii():  # letters stand for themselves, only a first byte can be a blank
                        text = mark + piece[1:].decode() if piece[0] == 0x20 else piece.decode()
                    else:
                        text = piece.decode("latin-1").translate(table)
                    added += [t.id for t in tokenize(text)]
                elif not empty:
                    added += next(rest)
                known[keys[i]] = numbers[i] = number
                number += 1
                behind.append(total + len(added))
            self.flat.extend(added)
            self.ends.extend(behind)
        number = np.array(numbers, np.int64)[place]
        ends = np.frombuffer(self.ends, np.int64).copy()
        begin, count = ends[number], ends[number + 1] - ends[number]
        before = np.concatenate(([0], np.cumsum(count)))
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        ids = flat[np.repeat(begin - before[:-1], count) + np.arange(before[-1])]
        del flat
        return ids, before[np.searchsorted(starts, offsets, "left")]


def vocabulary(path: str) -> int:
    """One more than the largest id that the tokenizer gives."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    return max(known.get_vocab(with_added_tokens=True).values(), default=0) + 1


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def encoded(texts: pa.Array, path: str, by_word: bool, end: int, limit: int = 2 << 20):
    """(first row, row after the last, list of each document's ids with ``end`` behind)."""
    known = encoder(path, by_word)
    for lo, hi, data, offsets in K.chunks(texts, limit):
        ids, bounds = known.encode(data, offsets)
        ids = np.insert(ids, bounds[1:], end)
        bounds = bounds + np.arange(len(bounds))
        yield lo, hi, ids, bounds
