"""Sorted hash tables of any size that every task looks up.

Up to so many entries a model's arrays are held in memory and broadcast.  Larger ones
are files: the driver writes them piece by piece, every executor fetches them once
(``SparkContext.addFile``), and tasks map them, so that only what is looked up is read
and the system may drop it again.  Lookups are the same for both.
"""

from __future__ import annotations

import atexit
import dataclasses
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.runtime import materialise

_PIECE = 1 << 18  # entries handled at once


@cache
def _folder() -> str:
    folder = tempfile.mkdtemp(prefix="lexifold-tables-")  # executors that come later fetch from it, too
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def zeros(n: int, kind: np.dtype | type, mapped: bool) -> np.ndarray:
    """In memory, or in a file of its own."""
    if not mapped or not n:
        return np.zeros(n, kind)
    return np.lib.format.open_memmap(f"{_folder()}/{uuid.uuid4().hex}.npy", "w+", kind, (n,))


def slices(n: int) -> Iterator[slice]:
    return (slice(first, min(n, first + _PIECE)) for first in range(0, n, _PIECE))


def _packed(columns: list[str]):
    """Map task: columns to rows of so many values' bytes, column behind column."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        arrays = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns]
        return pa.record_batch([pa.array([int(arrays[0][0])], pa.int64()), pa.array([len(arrays[0])], pa.int64()), pa.array([b"".join(a.tobytes() for a in arrays)], pa.binary())], names=["first", "n", "data"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _PIECE:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return task


def pieces(packed: DataFrame, kinds: list[np.dtype]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First value and columns of each packed row; one partition at a time is at the driver."""
    for first, n, data in packed.toLocalIterator():
        at, arrays = 0, []
        for kind in kinds:
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        yield first, arrays


def scattered(found: DataFrame, into: list[np.ndarray], columns: list[str]) -> None:
    """Write the columns' values to the places that ``hash`` names."""
    if not any(isinstance(array, np.memmap) for array in into):
        table = found.select("hash", *columns).toArrow()
        for array, c in zip(into, columns):
            array[table.column("hash").to_numpy()] = table.column(c).to_numpy()
        return
    packed = found.select("hash", *columns).mapInArrow(_packed(["hash", *columns]), "first bigint, n bigint, data binary")
    for _, (places, *values) in pieces(materialise(packed, "sums"), [np.dtype("i8")] + [a.dtype for a in into]):
        for array, own in zip(into, values):
            array[places] = own


def looked_up(found: DataFrame, columns: list[str], kind: type, held: int, spare: int = 0) -> list[np.ndarray]:
    """Column ``hash``, sorted, and the other columns beside it, with ``spare`` places more at the end; files beyond ``held`` rows."""
    n = found.count()
    mapped = n > held
    arrays = [zeros(n + spare, np.int64, mapped), *(zeros(n + spare, kind, mapped) for _ in columns)]
    if not mapped:
        table = found.select("hash", *columns).toArrow()
        keys = table.column("hash").to_numpy()
        order = np.argsort(keys)
        for array, values in zip(arrays, (keys, *(table.column(c).to_numpy() for c in columns))):
            array[:n] = values[order]
    else:
        ordered = found.select("hash", *columns).repartitionByRange("hash").sortWithinPartitions("hash")
        packed = materialise(ordered.mapInArrow(_packed(["hash", *columns]), "first bigint, n bigint, data binary"), "sorted")
        at, places = 0, {}
        for first, size in sorted(map(tuple, packed.select("first", "n").collect())):  # a row for every _PIECE entries
            places[first] = at
            at += size
        for first, values in pieces(packed, [a.dtype for a in arrays]):
            for array, own in zip(arrays, values):
                array[places[first] : places[first] + len(own)] = own
    arrays[0][n:] = np.iinfo(np.int64).max
    return arrays


class Sent:
    """A model whose mapped arrays are sent as files; used like a broadcast."""

    def __init__(self, spark: SparkSession, model) -> None:
        self._kind, self._plain, self._files = type(model), {}, {}
        for field in dataclasses.fields(model):
            value = getattr(model, field.name)
            if isinstance(value, np.memmap):
                value.flush()
                spark.sparkContext.addFile(value.filename)
                self._files[field.name] = str(value.filename).rpartition("/")[2]
            else:
                self._plain[field.name] = value

    @property
    def value(self):
        mapped = {name: np.load(SparkFiles.get(file), mmap_mode="r") for name, file in self._files.items()}
        return self._kind(**self._plain, **mapped)

    def destroy(self) -> None:
        """Files stay until the session ends: executors that come later fetch all of them."""


def send(spark: SparkSession, model):
    if any(isinstance(getattr(model, f.name), np.memmap) for f in dataclasses.fields(model)):
        return Sent(spark, model)
    return spark.sparkContext.broadcast(model)
