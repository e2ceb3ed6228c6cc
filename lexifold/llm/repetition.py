"""Share of a document's text that repeats earlier parts of the same document.

A document is reduced to its lower-cased letters.  A letter is repeated if it
lies in a run of ``run`` letters that also begins at an earlier place.  All runs of
all documents of a batch are hashed at once as differences of prefix sums, sorted,
and compared with the first run of the same hash; equal hashes are confirmed
letter by letter, so the result is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text's letters (Unicode L)."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_is_letter()[points]]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


def repeated_letters(texts: list[np.ndarray], run: int = 40, at_once: int = 1 << 20) -> np.ndarray:
    """Number of repeated letters of each text.

    Runs are sorted in hash classes of about ``at_once`` runs, which bounds the
    memory a very long text takes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    if not sizes.sum():
        return out
    joined = np.concatenate(texts)
    n = len(joined)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    starts = np.flatnonzero(np.arange(n) + run <= ends[owner])
    if not len(starts):
        return out
    mixed = (joined.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(_BASE, n))])
    hashes = (sums[starts + run] - sums[starts]) * _powers(_INVERSE, n)[starts]
    hashes ^= owner[starts].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    hashes ^= hashes >> np.uint64(31)
    del mixed, sums
    covered = np.zeros(n + 1, np.int32)
    classes = max(1, len(starts) // at_once)
    kind = hashes % np.uint64(classes) if classes > 1 else None
    for c in range(classes):
        at, h = (starts, hashes) if kind is None else (starts[kind == c], hashes[kind == c])
        order = np.argsort(h, kind="stable")
        ordered, at = h[order], at[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later, first = at[~new], first[~new]
        same = owner[later] == owner[first]
        for k in range(run):
            same &= joined[later + k] == joined[np.minimum(first + k, n - 1)]
        for i in np.unique(owner[later[~same]]):  # hashes that met by chance: this text letter by letter
            _by_letters(joined, ends[i] - sizes[i], ends[i], run, covered)
        covered += np.bincount(later[same], minlength=n + 1).astype(np.int32)
        covered -= np.bincount(later[same] + run, minlength=n + 1).astype(np.int32)
    marked = np.cumsum(covered[:-1]) > 0
    np.add.at(out, owner[marked], 1)
    return out


def _by_letters(joined: np.ndarray, first: int, end: int, run: int, covered: np.ndarray) -> None:
    seen = set()
    for at in range(first, end - run + 1):
        piece = joined[at : at + run].tobytes()
        if piece in seen:
            covered[at] += 1
            covered[at + run] -= 1
        seen.add(piece)


def repetition(texts: DataFrame, key: str = "doc_id", column: str = "text", run: int = 40, at_once: int = 1 << 20) -> DataFrame:
    """``key``, ``n_letters``, ``n_repeated`` and ``share`` of each row.

    Null, empty and blank texts, and any text of at most ``run`` letters, have no
    repeated letters; without letters the share is 0.  Repeated rows come out
    each; extra columns are ignored; an empty table gives an empty result.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column_of, keys = batch.column(column), batch.column(key)
            first, size, held = 0, 0, []
            for i in range(batch.num_rows):
                held.append(letters(column_of[i].as_py()))
                size += len(held[-1])
                if size >= at_once or i + 1 == batch.num_rows:
                    n = np.array([len(t) for t in held], np.int64)
                    repeated = repeated_letters(held, run, at_once)
                    share = np.where(n > 0, repeated / np.maximum(n, 1), 0.0)
                    yield pa.record_batch([keys.slice(first, len(held)), pa.array(n), pa.array(repeated), pa.array(share)], names=[key, "n_letters", "n_repeated", "share"])
                    first, size, held = i + 1, 0, []

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, column).mapInArrow(task, f"`{key}` {kind}, n_letters bigint, n_repeated bigint, share double")
