"""Whole texts to token ids with the tokenizers library, inside Arrow batches.

Both public vocabularies start a new token at every blank that follows a non-blank, and
between a letter and an ASCII sign. So the ids of a text are the ids of its pieces in a row.
Each distinct piece is encoded by the library once and remembered by the worker; texts where
a cut is not certain are cut at the certain places only. ``tests/llm`` holds the result
against encoding each text whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Words and pieces that a worker remembers in each of two generations, and the longest of them; bounds memory to some 50 and 5 MB a generation, never the result.
WORDS, PIECES, LONGEST = 250_000, 25_000, 64
#: Bytes of text that are encoded together.
TOGETHER = 8 << 20
#: A blank that follows a non-blank: both vocabularies start a new token there.
CUT = re.compile(r"(?<=\S)(?= )")
#: A run of letters that no normaliser joins with its neighbours, then nothing or an ASCII sign and the rest.
WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)((?:[!-/:-@\[-`{-~\n0-9].*)?)", re.DOTALL)


class _Unsure(Exception):
    pass


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """Letters of WORD in the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}


BYTE_LETTERS = _byte_letters()
#: Runs of which every letter has a spelling there.
SPELLED = re.compile(r"[\x00-\u024F]*")
#: A blank in the same alphabet.
BLANK = "\u0120"


class Generations(dict):
    """A bounded memory: when one generation is full it becomes the old one; what is used again moves on."""

    def __init__(self, compute, most: int) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.compute, self.most = compute, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(piece) > LONGEST:
            return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts, little-endian 32-bit."""

    def __init__(self, path: str, keeps_blanks: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.keeps_blanks = keeps_blanks
        self.later = Generations(self._after_blank, PIECES)  # pieces after a blank
        self.words = Generations(self._word, WORDS)  # runs of letters after a blank
        self.alone = Generations(self._whole, PIECES)  # pieces as they stand

    def _whole(self, piece: str) -> bytes:
        return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _word(self, letters: str) -> bytes:
        """One run of letters is one word of the model: its normaliser and splitter are not needed.

        Lower-casing can leave the letters whose spelling in the model's alphabet is known; such a
        run goes through the whole tokenizer.
        """
        text = letters if self.keeps_blanks else letters.lower()
        if not text.isascii():
            if not SPELLED.fullmatch(text):
                return self._whole(" " + letters if self.keeps_blanks else letters)
            text = text.translate(BYTE_LETTERS)
        return _packed([t.id for t in self.model.tokenize(BLANK + text if self.keeps_blanks else text)])

    def _after_blank(self, piece: str) -> bytes:
        if self.keeps_blanks and (not piece or piece[-1].isspace()):
            raise _Unsure  # blanks in a row form tokens of their own
        if piece.isascii() and piece.isalpha():
            return self.words[piece]
        if m := WORD.fullmatch(piece):
            return self.words[m[1]] + self.alone[m[2]] if m[2] else self.words[m[1]]
        return self._whole(" " + piece if self.keeps_blanks else piece)

    def encode(self, text: str, end_id: int) -> np.ndarray:
        end = end_id.to_bytes(4, "little")
        first, *rest = text.split(" ")
        try:
            if self.keeps_blanks and rest and (not first or first[-1].isspace()):
                raise _Unsure
            ids = b"".join([self.alone[first], *map(self.later.__getitem__, rest), end])
        except _Unsure:
            ids = b"".join([*map(self.alone.__getitem__, CUT.split(text)), end])
        return np.frombuffer(ids, dtype="<u4")


    def encode_all(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of many texts, nulls empty: each distinct piece is looked up once, its ids are copied to all its places."""
        split = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        place, pieces, n = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), len(split)
        first, count = offsets[:-1], np.diff(offsets)
        unsure = np.zeros(n, dtype=bool)
        if self.keeps_blanks:  # blanks in a row: such texts are cut at the certain places only
            odd = np.array([not p or p[-1].isspace() for p in pieces], dtype=bool)[place]
            odd[first[count == 1]] = False
            unsure[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        used = np.zeros(len(pieces), dtype=bool)
        used[np.delete(place, first)] = True
        blank = lambda p: self.keeps_blanks and (not p or p[-1].isspace())
        entries = [self._after_blank(p) if u and not blank(p) else b"" for p, u in zip(pieces, used.tolist())]
        for i in range(n):  # the first piece of a text stands alone; a text that is not cut at blanks is one entry
            head = pieces[place[first[i]]]
            if unsure[i]:
                text = " ".join(pieces[j] for j in place[first[i]:offsets[i + 1]].tolist())
                entries.append(b"".join(map(self.alone.__getitem__, CUT.split(text))))
            else:
                entries.append(self.alone[head] if self.keeps_blanks else self._after_blank(head))
        size = np.array([len(e) // 4 for e in entries], dtype=np.int64)
        start, known = np.cumsum(size) - size, np.frombuffer(b"".join(entries), dtype="<u4")
        place[first] = len(pieces) + np.arange(n)
        owner = np.repeat(np.arange(n), count)
        kept = ~unsure[owner]
        kept[first] = True
        place, owner = place[kept], owner[kept]
        many = size[place]
        ends = np.bincount(owner, weights=many, minlength=n).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(ends)])
        out = np.full(bounds[-1], end_id, dtype="<u4")
        narrow = np.int32 if max(bounds[-1], len(known)) < 1 << 31 else np.int64
        shift = (start[place] - (np.cumsum(many) - many)).astype(narrow)
        flat = np.arange(many.sum(), dtype=narrow)
        ids = known[flat + np.repeat(shift, many)]
        flat += np.repeat(owner.astype(narrow), many)
        out[flat] = ids
        return bounds, out


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def vocabulary(name_or_path: str) -> str:
    """A public vocabulary by name, or a file path as it is."""
    return name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)


def encoder(name_or_path: str, keeps_blanks: bool) -> PieceEncoder:
    """One encoder per worker process."""
    key = (name_or_path, keeps_blanks)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(vocabulary(name_or_path), keeps_blanks)
    return _ENCODERS[key]


def together(batch: pa.RecordBatch, column: int, limit: int = TOGETHER):
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is one slice."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def texts(column: pa.Array, step: int = 256):
    """(offset, python strings) in small slices, so that a batch never exists twice; null is empty."""
    for at in range(0, len(column), step):
        yield at, [t or "" for t in column.slice(at, step).to_pylist()]
