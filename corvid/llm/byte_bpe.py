"""Byte-level BPE as a finite-state transducer that is made deterministic only where texts lead, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are that of theirs: the first merge across a border
would also happen in the pair alone. So each place of a word has one encoding of what stands before it, and a transducer needs to guess only where the token that
it is reading began, and to hold the token, once it ends, against the last one of that place. The sets of live guesses are the states of a deterministic machine,
whose steps are compiled when a text first takes them. Tokens are put out as soon as all live guesses agree on them.
"""

from __future__ import annotations

import array
import base64
import contextlib
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, row_beside, text_or_empty
from .tokenizing import _Memo, units

#: Compiled steps, pairs of tokens and first bytes of words that a machine keeps (beyond, it begins anew), how many bytes these are, and places of a
#: word that wait for the guesses to agree.
STEPS, HEAD, HELD = 300_000, 6, 4096
# Fixed value: the usual pattern, of which units() is known to cut texts only where it does.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words and their ids that a worker remembers.
WORDS = 80 << 20
#: Texts that a worker encodes at a time, and about the characters or ids of one result batch.
TEXTS, BATCH = 256, 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a .tiktoken file (base64, rank), which must hold every single byte."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path}: no token for the bytes {missing}")
    return ranks


class Transducer:
    """bytes of one word -> its ids. ranks: token -> rank, the order of its merge, also its id.

    The machine's state is the set of its live guesses, of which the longest names all. A step is a byte, and comes with the tokens that may end there. The token that
    does is the longest that follows the last one of the place where it begins.
    """

    def __init__(self, ranks: dict[bytes, int], room: int = STEPS):
        self.ranks, self.room = ranks, room
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)} | {b""}
        self.trees: dict[bytes, tuple[list, list] | None] = {b"": ([], [])}
        self._renew()

    def _renew(self) -> None:
        self.states: dict[bytes, tuple[bytes, dict[int, tuple], list[tuple[bytes, int]]]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.heads: dict[bytes, tuple[tuple, list[bytes]]] = {}
        self.compiled = 0
        self.start = self._state(b"")

    def _state(self, guess: bytes) -> tuple[bytes, dict[int, tuple], list[tuple[bytes, int]]]:
        """(longest live guess, next state by byte, tokens that may end here with their lengths)."""
        if guess not in self.states:
            self.states[guess] = (guess, {}, [(t, len(t)) for k in range(len(guess)) if (t := guess[k:]) in self.ranks and self._spines(t) is not None])
        return self.states[guess]

    def _compile(self, state: tuple, byte: int) -> tuple:
        guess = state[0] + bytes([byte])
        while guess not in self.begins:  # guesses that began before have died
            guess = guess[1:]
        state[1][byte] = step = self._state(guess)
        self.compiled += 1
        return step

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The plain rule, for a few bytes: the leftmost of the earliest merges, until none or least parts are left."""
        never = 1 << 62
        rank = lambda a, b: self.ranks.get(a + b, never)
        parts = [data[k : k + 1] for k in range(len(data))]
        joins = [*map(rank, parts, parts[1:])]
        while len(parts) > least and (first := min(joins)) < never:
            at = joins.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at < len(joins):
                joins[at] = rank(parts[at], parts[at + 1])
            if at:
                joins[at - 1] = rank(parts[at - 1], parts[at])
        return parts

    def _spines(self, token: bytes) -> tuple[list, list] | None:
        """The parts at the token's right and left edge, the whole first, with the ranks at which they come about (-1: single bytes).

        None if merges never make the token. Empty lists if a part's rank is above the whole's, so that ranks don't tell the order.
        """
        if token not in self.trees:
            if len(token) == 1:
                self.trees[token] = ([(token, -1)], [(token, -1)])
            elif len(halves := self.merged(token, 2)) != 2:
                self.trees[token] = None
            else:
                left, right = map(self._spines, halves)
                rank = self.ranks[token]
                if left is None or right is None or not left[1] or not right[0] or max(left[1][0][1], right[0][0][1]) > rank:
                    self.trees[token] = ([], [])
                else:
                    self.trees[token] = ([(token, rank), *right[0]], [(token, rank), *left[1]])
        return self.trees[token]

    def follows(self, before: bytes, token: bytes) -> bool:
        """No merge across the border between the two comes before the merges that take the parts at it further."""
        a, b = self._spines(before)[0], self._spines(token)[1]
        if not before:
            return True
        if not a or not b:
            return self.merged(before + token) == [before, token]
        i = j = 0
        rank = self.ranks.get
        a_ends = b_ends = 1 << 61  # when the parts go up in larger ones
        while True:
            (x, x_made), (y, y_made) = a[i], b[j]
            crossing = rank(x + y, 1 << 62)
            if crossing < a_ends and crossing <= b_ends:  # at a tie the left one is first
                return False
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                a_ends, i = x_made, i + 1
            else:
                b_ends, j = y_made, j + 1

    def encode(self, word: bytes) -> list[int]:
        """The ids of a word. A word that is a token itself is that token, reachable by merges or not, as in the library."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        if self.compiled + len(self.pairs) + len(self.heads) > self.room:
            self._renew()
        head = word[:HEAD]
        if head not in self.heads:
            last = [b""]  # at each place since what is put out: the last token of the text before it
            self.heads[head] = (self._read(self.start, head, last, []), last)
        state, last = self.heads[head]
        last, ids = last.copy(), []
        self._read(state, word[HEAD:], last, ids)
        return ids + self._traced(last, len(last) - 1)

    def _read(self, state: tuple, part: bytes, last: list[bytes], ids: list[int]) -> tuple:
        """The state after part; last grows, and ids by what all guesses agree on."""
        pairs = self.pairs
        for byte in part:
            state = state[1].get(byte) or self._compile(state, byte)
            for token, size in state[2]:
                key = (last[-size], token)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.follows(*key)
                if fits:
                    last.append(token)
                    break
            if not len(last) % HELD:
                put = self._agreed(last, state[0])
                ids += self._traced(last, put)
                del last[:put]
        return state

    def _agreed(self, last: list[bytes], guess: bytes) -> int:
        """The furthest place that all live guesses have in common."""
        end = len(last) - 1
        places = {end - len(guess) + k for k in range(len(guess) + 1) if guess[k:] in self.begins}
        while len(places) > 1:
            at = max(places)
            places.remove(at)
            places.add(at - len(last[at]))
        return places.pop()

    def _traced(self, last: list[bytes], at: int) -> list[int]:
        back = []
        while at > 0:
            back.append(self.ranks[last[at]])
            at -= len(last[at])
        return back[::-1]


class Decoder:
    """Ids in, text out as soon as its characters are whole; bytes that aren't UTF-8 become U+FFFD as in bytes.decode('replace').

    A state is the begun character's bytes: at most three. Tokens that are whole characters keep the empty state, and text follows
    from joining them. Other tokens take a step of the machine, compiled when it is first taken.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.whole: dict[int, str] = {}
        for i, t in self.tokens.items():
            try:
                self.whole[i] = t.decode()
            except UnicodeDecodeError:
                pass
        self.steps: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.begun = b""

    @staticmethod
    def tail(data: bytes) -> int:
        """Bytes at the end of data that may begin a character: a leading byte, and as many fitting ones as there are."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
                second = data[-back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                return back if size > back and (second is None or low <= second <= high) else 0
        return 0

    def _step(self, token: int) -> str:
        key = (self.begun, token)
        if key not in self.steps:
            if token not in self.tokens:
                raise ValueError(f"no token has the id {token}")
            data = self.begun + self.tokens[token]
            kept = self.tail(data)
            self.steps[key] = (data[len(data) - kept :], data[: len(data) - kept].decode(errors="replace"))
        self.begun, text = self.steps[key]
        return text

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that are whole after these ids."""
        ids = list(ids)
        if not self.begun:
            with contextlib.suppress(KeyError):
                return "".join(map(self.whole.__getitem__, ids))
        return "".join(self.whole[i] if not self.begun and i in self.whole else self._step(i) for i in ids)

    def end(self) -> str:
        """What an unfinished character at the end becomes; the decoder is as new."""
        text, self.begun = self.begun.decode(errors="replace"), b""
        return text


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str):
    """(text -> ids as little-endian unsigned 32-bit bytes, decoder) of a worker."""
    ranks = read_ranks(path)
    machine = Transducer(ranks)
    split = regex.compile(pattern).findall

    usual = pattern == USUAL

    def coded(unit: str) -> bytes:
        if usual and unit.isascii() and unit.removeprefix(" ").isalpha():  # one match
            return array.array("I", machine.encode(unit.encode())).tobytes()
        return array.array("I", [i for word in split(unit) for i in machine.encode(word.encode())]).tobytes()

    memo = _Memo(coded, WORDS).__getitem__
    cut = units if usual else split

    def encode(text: str) -> bytes:
        return b"".join(map(memo, cut(text)))

    return encode, Decoder(ranks)


def _claimed(path: str, pattern: str):
    claim(f"{path} {hashlib.sha256(pattern.encode()).hexdigest()}", _coder.cache_clear)
    return _coder(path, pattern)


def _lists(parts: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // 4 for p in parts)]), pa.int32()), pa.array(flat))


def _slices(b: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of about BATCH in size, TEXTS at most and one at least, so that a batch of long texts doesn't stand in memory at once."""
    at = 0
    ends = np.cumsum(sizes)
    while at < b.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right"))
        stop = min(max(stop, at + 1), at + TEXTS, b.num_rows)
        yield b.slice(at, stop - at)
        at = stop


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs without text_col, and ids_col: the ids of the whole text (array<int>), each match of pattern encoded apart.

    ranks_path: a .tiktoken file that all workers can read. Special tokens aren't known: their strings are text. Between matches
    nothing is encoded (the usual pattern leaves nothing between).

    Nulls: a null text is an empty one and has no ids; other columns are kept as they are, whatever their names, but for one called
    ids_col, which must not be there (ValueError). Empty table: empty result. Repeated rows: each has its row. Ties: the
    leftmost of equal merges, as in the library. A text's length has no limit; the machine reads a word once, from left to right.
    """
    if ids_col in (others := [c for c in docs.columns if c != text_col]):
        raise ValueError(f"there is a column {ids_col} already")
    held, schema = row_beside(docs, others, "text", text_or_empty(f"`{text_col}`"), "ids array<int>")

    def run(batches):
        to_ids, _ = _claimed(ranks_path, pattern)
        for b in batches:
            for part in _slices(b, pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([to_ids(t) for t in part.column(1).to_pylist()])], names=["row", "ids"])

    coded = held.mapInArrow(run, schema)
    return coded.select(*(F.col("row")[c].alias(c) for c in others), F.col("ids").alias(ids_col))


def decode(coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded without ids_col, and text_col: the text of the ids, through the streaming decoder.

    Nulls: null ids are an empty text, a null id in a list is an error like any id that no token has. Ids that don't make up UTF-8 give
    U+FFFD. Empty tables, repeated rows, other columns and a clash of text_col are as for encode().
    """
    if text_col in (others := [c for c in coded.columns if c != ids_col]):
        raise ValueError(f"there is a column {text_col} already")
    held, schema = row_beside(coded, others, "ids", F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")), "text string")

    def run(batches):
        _, decoder = _claimed(ranks_path, pattern)
        for b in batches:
            for part in _slices(b, pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)):
                lists = part.column(1)
                if lists.flatten().null_count:
                    raise ValueError("a list of ids holds a null")
                flat, ends = lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                texts = [decoder.feed(ids.tolist()) + decoder.end() for ids in np.split(flat, ends[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    out = held.mapInArrow(run, schema)
    return out.select(*(F.col("row")[c].alias(c) for c in others), F.col("text").alias(text_col))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids and the decoded text of each row of docs, of which only these two columns are read."""
    coded = encode(docs.select(id_col, text_col), ranks_path, pattern, text_col, "ids")
    kept = coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("ids").alias("sent"))
    return decode(kept, ranks_path, pattern, "sent", "decoded")
