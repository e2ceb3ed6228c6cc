"""Byte-level BPE in linear time, with ids equal to those of exact merging.

The vocabulary is searched with an Aho-Corasick automaton over bytes written as
Latin-1 text.  A piece is covered from left to right with the longest token that
starts at each position.  A token may follow another only if the two are
compatible: merging their joint bytes gives exactly the two again.  A sequence
whose neighbours are all compatible is the one that merging produces, so where
the longest token doesn't fit a shorter prefix token is tried, and failing that
the last token is taken back.  Positions found to lead nowhere are remembered,
which keeps the work linear.  Compatibility is memoised by pair of tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The public tokenizers' folder; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"

# Fixed value: the public pattern that cuts text into pieces before merging.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Bpe:
    """The tokenizer in ``folder``; ids are the ranks of its vocabulary file."""

    def __init__(self, folder: str = TOKENIZERS, name: str = NAME, most_pieces: int = 200_000) -> None:
        self.rank: dict[bytes, int] = {}
        with open(f"{folder}/{name}.tiktoken", "rb") as file:
            for line in file:
                if line.strip():
                    token, number = line.split()
                    self.rank[base64.b64decode(token)] = int(number)
        self.token = {number: token for token, number in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (number, len(token)))
        self.automaton.make_automaton()
        self.most_pieces = most_pieces
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int | None] = {}

    def ids(self, text: str | None) -> list[int]:
        """Token ids of a text, all of it ordinary text; [] for null and empty."""
        out: list[int] = []
        if text:
            known = self._pieces
            for piece in PIECES.findall(text):
                out += known.get(piece) or self._piece(piece)
        return out

    def length(self, text: str | None) -> int:
        """Number of token ids of a text."""
        if not text:
            return 0
        known = self._pieces
        return sum([len(known.get(piece) or self._piece(piece)) for piece in PIECES.findall(text)])

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        found = (self.rank[raw],) if raw in self.rank else tuple(self.cover(raw))
        if len(self._pieces) >= self.most_pieces:
            self._pieces.clear()
        if len(piece) <= 64:
            self._pieces[piece] = found
        return found

    def cover(self, raw: bytes) -> list[int]:
        """Ids of one piece by backtracking from longest matches."""
        longest: list[int | None] = [None] * len(raw)
        size = [0] * len(raw)
        for last, (number, n) in self.automaton.iter(raw.decode("latin-1")):
            start = last - n + 1
            if n > size[start]:
                size[start], longest[start] = n, number
        alive = bytearray(b"\1") * (len(raw) + 1)
        path: list[int] = []
        at, trial = 0, longest[0]
        while at < len(raw):
            while trial is not None:
                end = at + len(self.token[trial])
                if alive[end] and (not path or self.fits(path[-1], trial)):
                    break
                trial = self.shorter(trial)
            if trial is None:
                alive[at] = 0
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                trial = path.pop()
                at -= len(self.token[trial])
                continue
            path.append(trial)
            at = end
            trial = longest[at] if at < len(raw) else None
        return path

    def shorter(self, number: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if number not in self._shorter:
            raw = self.token[number]
            self._shorter[number] = next((self.rank[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.rank), None)
        return self._shorter[number]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joint bytes gives these two tokens."""
        pair = (left, right)
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            found = self._fits[pair] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Exact merging of a few bytes: always the lowest-ranked neighbouring pair, leftmost first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            lowest = min(ranks)
            if lowest == 1 << 30:
                break
            i = ranks.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]


@cache
def tokenizer(folder: str = TOKENIZERS, name: str = NAME) -> Bpe:
    """One tokenizer per worker process."""
    return Bpe(folder, name)


def encode(texts: DataFrame, key: str = "doc_id", column: str = "text", folder: str = TOKENIZERS, name: str = NAME, rows: int = 256) -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text.

    Null and empty texts give an empty list, blank texts the ids of their blanks.
    Repeated rows are encoded each; extra columns are ignored; an empty table gives
    an empty result.  Batches of ``rows`` bound a task's memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(folder, name)
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                ids = pa.array([bpe.ids(t) for t in batch.column(column).to_pylist()], pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(key), ids], names=[key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, column).mapInArrow(task, f"`{key}` {kind}, ids array<int>")


def token_counts(texts: DataFrame, keep: list[str], column: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of token ids of each whole text; 0 for null, empty and blank texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(folder, name)
        for batch in batches:
            sizes = [bpe.length(t) if t and not t.isspace() else 0 for t in batch.column(column).to_pylist()]
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keep)
    return texts.select(*keep, column).mapInArrow(task, f"{kinds}, n_tokens bigint")

