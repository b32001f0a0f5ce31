"""Public tokenizers with a bounded memory of the units that they split texts into anyway.

Both kinds cut a text before merging anything: the byte-level one by its word pattern, the piece model because none of
its pieces holds a space mark after another character. A text is therefore split where a space follows a
non-space character, each distinct unit is encoded by the library once per worker, and the results are joined. Where the
split isn't provably neutral the library encodes the whole text. The byte-level one splits the texts of a batch at once, in
their UTF-8 bytes, and looks a unit up once a batch.
"""

from __future__ import annotations

import array
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import claim

#: Bytes of units and their results that a worker remembers, the longest unit that is remembered (others are encoded each
#: time), and bytes that an entry takes besides its characters and results.
MEMO_BYTES, MEMO_CHARS, ENTRY_BYTES = 150 << 20, 48, 200
#: About the bytes of the texts that are split at once.
CHUNK_BYTES = 4 << 20
_GAP = re.compile(r"(?<=\S)(?= )")
# Each begins with its class of characters, which the search then skips to; one expression for both, or one that looks behind first, is tried at every character.
_TWO_BLANKS, _LONE_STOP = re.compile(r"\s\s"), re.compile(r"[.,](?<![A-Za-zÀ-ÖØ-öø-ÿ0-9][.,])")


def version_digest(path: str) -> str:
    """SHA-256 of a tokenizer's file: its version in the cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def units(text: str) -> list[str]:
    """Pieces of text that the word pattern never joins: cut before a space, full stop or comma and round a line end.

    That holds if no two white-space characters meet and each full stop or comma follows a letter or digit; else the
    text is cut only before a space that follows a character other than white space.
    """
    if "\0" in text or _LONE_STOP.search(text) or _TWO_BLANKS.search(text):
        return _GAP.split(text)
    return text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")


def _bytes_of(*values: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_MARKS, _STOPS = _bytes_of(*b" .,\n"), _bytes_of(*b".,")
_ASCII_WHITE, _ASCII_WORD = _bytes_of(*range(9, 14), *range(28, 33)), _bytes_of(*range(48, 58), *range(65, 91), *range(97, 123))
#: White space of two and three bytes in UTF-8, as numbers.
_WHITE = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])


def _white(data: np.ndarray, near: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Whether characters are white space. Places in data: a byte of each, and where it begins if it has two or three."""
    found = _ASCII_WHITE[data[near]]
    odd = np.flatnonzero(data[near] >= 128)
    for first, size in ((two[odd], 2), (three[odd], 3)):
        found[odd] |= np.isin(sum(data[first + k].astype(np.int32) << 8 * (size - 1 - k) for k in range(size)), _WHITE)
    return found


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which the word pattern never has a match across, whose units it splits as it splits the whole.

    Before a space or line end that follows other than white space, before a full stop or comma that follows a letter or digit
    (ASCII or Latin-1), and behind a line end with no white space on either side. Data may be several texts, cut where they begin besides: what
    stands before a text only keeps it from being cut.
    """
    around = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
    at = np.flatnonzero(_MARKS[data])
    mark = data[at]
    fits = ~_white(around, at + 2, at + 1, at)
    stop = np.flatnonzero(_STOPS[mark])
    last = around[at[stop] + 2]
    fits[stop] = _ASCII_WORD[last] | (around[at[stop] + 1] == 0xC3) & (last != 0x97) & (last != 0xB7)
    behind = at[fits & (mark == 10)] + 1
    behind = behind[~_white(around, behind + 3, behind + 3, behind + 3)]
    return np.concatenate([at[fits], behind])


class _Memo(dict):
    """unit -> encode(unit), computed when a unit is first looked up.

    Two generations: when the young one is full it becomes the old one, from which units in use move back; rare units go.
    """

    def __init__(self, encode, room: int = MEMO_BYTES):
        super().__init__()
        self.encode, self.old, self.used, self.room = encode, {}, 0, room

    def __missing__(self, unit):
        value = self.old.get(unit)
        if value is None:
            value = self.encode(unit)
            if len(unit) > MEMO_CHARS:
                return value
        self.used += ENTRY_BYTES + len(unit) + (len(value) if isinstance(value, bytes) else 0)
        if self.used > self.room // 2:
            self.old, self.used = dict(self), 0
            self.clear()
        self[unit] = value
        return value


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b if b in shown else 256 + sum(c not in shown for c in range(b)) for b in range(256)}


@lru_cache(maxsize=4)
def byte_level_batches(path: str, room: int = MEMO_BYTES):
    """An Arrow array of texts -> for some texts at a time, in order: all their ids (unsigned 32-bit), the number of each text's; for a byte-level .json tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()

    def word(unit: str) -> list[int]:
        """A unit that the word pattern leaves whole goes straight to the library's model, its bytes written as letters."""
        return [t.id for t in model.tokenize(unit.encode().decode("latin-1").translate(letters))]

    probe = (" the", "Écoleß", " naïveté", "thorealynd")
    direct = all(word(u) == tokenizer.encode(u, add_special_tokens=False).ids for u in probe)

    def encode(unit: str) -> bytes:
        if direct and (unit.isalpha() or (unit[:1] == " " and unit[1:].isalpha())):
            return array.array("I", word(unit)).tobytes()
        return array.array("I", tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    ids = _Memo(encode, room).__getitem__

    def part(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ends: of the texts in data, with the first one's start before them."""
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts(data)] = True
        begins[ends] = True
        begins = np.flatnonzero(begins)
        found = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]).dictionary_encode()
        coded = pa.array(map(ids, found.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(found.indices)
        _, places, flat = coded.buffers()
        places = np.frombuffer(places, np.int64, len(begins))[np.searchsorted(begins, ends)] // 4
        return np.frombuffer(flat or b"", "<u4", places[-1]), np.diff(places)

    def run(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        claim(path, byte_level_batches.cache_clear)
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1)
            yield part(ends[at : stop + 1] - ends[at], np.frombuffer(data or b"", np.uint8)[ends[at] : ends[stop]])
            at = stop

    return run


def byte_level(path: str, room: int = MEMO_BYTES):
    """texts -> the ids of each as little-endian unsigned 32-bit bytes, for a byte-level .json tokenizer."""
    batches = byte_level_batches(path, room)

    def run(texts: list[str]) -> list[bytes]:
        return [x.tobytes() for flat, sizes in batches(pa.array(texts, pa.large_string())) for x in np.split(flat, np.cumsum(sizes)[:-1])]

    return run


@lru_cache(maxsize=4)
def piece_counts(path: str):
    """texts -> the number of pieces of each, for a sentencepiece .model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    crossing = any(mark in piece.lstrip(mark) for piece in map(model.id_to_piece, range(model.get_piece_size())))
    probe = "a  b éﬁ c"
    plain = model.encode(probe, out_type=str) == model.encode(probe.replace(" ", mark), out_type=str) and model.decode(model.encode(probe)) == probe
    count = _Memo(lambda unit: len(model.encode(unit))).__getitem__

    def whole(text: str) -> bool:
        """The pieces of its words may not be those of the text."""
        return crossing or not plain or not text or mark in text or text[0] == " " or text[-1] == " " or "  " in text

    def run(texts: list[str]) -> list[int]:
        claim(path, piece_counts.cache_clear)
        return [len(model.encode(t)) if whole(t) else sum(map(count, t.split(" "))) for t in texts]

    return run
