"""Counting of every distinct term with burst tries.

A burst trie's inner nodes branch on one character each; what hangs below a branch is
a compact container of suffixes with their two counters, of occurrences and of
records, until it holds more than ``capacity`` suffixes.  Then it bursts into a node
with a container per next character, so the depth follows the data.  Each map task
counts its records into one trie.  Its containers leave the task as rows: the path to
them and the sorted suffixes with their counters.

Containers of different tasks for the same part of the vocabulary can sit at
different depths.  They are routed by one common set of adaptive prefixes: a
prefix is opened if it carries more than 1/``fanout`` of all leaf entries, and a
term travels under its shortest prefix that isn't open.  At most ``fanout``
prefixes can be open on each of ``depth`` levels, whatever the size of the
collection, so the set of open prefixes is small enough to be sent to every task.
Containers that arrive under one route are merged into one trie: where a path leads
nowhere yet the whole container is hung in, where it ends at another container both
are added up, and where one of them has burst the other follows its branches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.llm.lexing import terms
from lexifold.runtime import materialise

LEAVES = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>, n_records bigint"
MERGED = "term string, occurrences bigint, records bigint"


class Node(dict):
    """An inner node: children by character; under "" the counters of the term that ends here."""

    __slots__ = ()


class Trie:
    """Terms with occurrences and records; a container is a plain dict of suffixes to both counters."""

    def __init__(self, capacity: int) -> None:
        self.root, self.capacity, self.size = Node(), capacity, 0

    def add(self, term: str, occurrences: int, records: int, node: Node | None = None, at: int = 0) -> None:
        """Add to the counters of ``term``, whose first ``at`` characters lead to ``node``."""
        node = self.root if node is None else node
        while True:
            if at == len(term):
                held, key = node, ""
                break
            child = node.get(term[at])
            if child is None:
                child = node[term[at]] = {}
            at += 1
            if type(child) is dict:
                held, key = child, term[at:]
                break
            node = child
        counters = held.get(key)
        if counters is not None:
            counters[0] += occurrences
            counters[1] += records
            return
        held[key] = [occurrences, records]
        self.size += 1
        if type(held) is dict and len(held) > self.capacity:
            node[term[at - 1]] = self._burst(held)

    def _burst(self, container: dict) -> Node:
        top = Node()
        waiting = [(top, container)]
        while waiting:
            node, held = waiting.pop()
            for suffix, counters in held.items():
                if suffix:
                    node.setdefault(suffix[0], {})[suffix[1:]] = counters
                else:
                    node[""] = counters
            for head, child in list(node.items()):
                if head and len(child) > self.capacity:
                    node[head] = Node()
                    waiting.append((node[head], child))
        return top

    def hang(self, prefix: str, suffixes: list[str], occurrences: list[int], records: list[int]) -> None:
        """Merge a container that sits at ``prefix``."""
        node = self.root
        for at, head in enumerate(prefix):
            child = node.get(head)
            if child is None and at + 1 == len(prefix):
                held = dict(zip(suffixes, map(list, zip(occurrences, records))))
                node[head] = held if len(held) <= self.capacity else self._burst(held)
                self.size += len(held)
                return
            if child is None:
                child = node[head] = Node()
            if type(child) is dict:  # a container on the way: its suffixes go on from here
                for s, o, r in zip(suffixes, occurrences, records):
                    self.add(prefix + s, o, r, node, at)
                    if type(node[head]) is not dict:
                        break
                else:
                    return
                done = suffixes.index(s) + 1  # it has burst
                return self.hang(prefix, suffixes[done:], occurrences[done:], records[done:])
            node = child
        for s, o, r in zip(suffixes, occurrences, records):
            self.add(prefix + s, o, r, node, len(prefix))

    def containers(self) -> Iterator[tuple[str, list[tuple[str, list[int]]]]]:
        """Paths and sorted suffixes with their counters, in order of the terms."""
        waiting: list[tuple[str, dict]] = [("", self.root)]
        while waiting:
            path, held = waiting.pop()
            if type(held) is dict:
                yield path, sorted(held.items())
                continue
            if "" in held:
                yield path, [("", held[""])]
            waiting += [(path + head, held[head]) for head in sorted((h for h in held if h), reverse=True)]


_LEAF_TYPES = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))


def local_tries(columns: list[str], capacity: int, most_terms: int):
    """Map task: rows of texts to the containers of its trie."""

    def leaves(trie: Trie, n_records: int) -> pa.RecordBatch:
        rows = [(path, [s for s, _ in held], [c[0] for _, c in held], [c[1] for _, c in held], 0) for path, held in trie.containers()]
        rows.append((None, [], [], [], n_records))  # the task's number of records with a term
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (*_LEAF_TYPES, pa.int64()))], names=["prefix", "suffixes", "occurrences", "records", "n_records"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, n_records = Trie(capacity), 0
        for batch in batches:
            for texts in zip(*(batch.column(c).to_pylist() for c in columns)):
                found = [t for text in texts for t in terms(text)]
                if found:
                    n_records += 1
                    add = trie.add
                    for term, n in Counter(found).items():
                        add(term, n, 1)
            if trie.size > most_terms:
                yield leaves(trie, n_records)
                trie, n_records = Trie(capacity), 0
        if n_records:
            yield leaves(trie, n_records)

    return task


def route(term: str, opened: frozenset[str]) -> str:
    """The shortest prefix of the term that isn't open; the term if all are."""
    for length in range(1, len(term) + 1):
        if term[:length] not in opened:
            return term[:length]
    return term


def routed(opened: frozenset[str]):
    """Map task: containers under their common routes, cut up where a route lies deeper."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for leaf in batch.to_pylist():
                prefix, suffixes = leaf["prefix"], leaf["suffixes"]
                path = route(prefix, opened)
                if prefix and path not in opened:
                    rows.append((path, prefix, suffixes, leaf["occurrences"], leaf["records"]))
                    continue
                paths = [route(prefix + s, opened) for s in suffixes]
                first = 0
                for i in range(1, len(paths) + 1):
                    if i == len(paths) or paths[i] != paths[first]:
                        cut = len(paths[first]) - len(prefix)
                        rows.append((paths[first], paths[first], [s[cut:] for s in suffixes[first:i]], leaf["occurrences"][first:i], leaf["records"][first:i]))
                        first = i
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *_LEAF_TYPES))], names=["route", "prefix", "suffixes", "occurrences", "records"])

    return task


def merged(capacity: int):
    """Reduce task: the containers of one route after the other, each route merged into one trie and handed on term by term.

    A task holds one route at a time, at most 1/fanout of all entries.
    """

    def rows(trie: Trie) -> Iterator[pa.RecordBatch]:
        out = [(path + suffix, *counters) for path, held in trie.containers() for suffix, counters in held]
        for first in range(0, len(out), 50_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[first : first + 50_000]), (pa.string(), pa.int64(), pa.int64()))], names=["term", "occurrences", "records"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, Trie(capacity)
        for batch in batches:
            for path, *container in zip(*(batch.column(c).to_pylist() for c in ("route", "prefix", "suffixes", "occurrences", "records"))):
                if path != now:
                    yield from rows(trie)
                    now, trie = path, Trie(capacity)
                trie.hang(*container)
        yield from rows(trie)

    return task


def count_terms(
    texts: DataFrame, columns: list[str], capacity: int = 2048, fanout: int = 512, depth: int = 8, most_terms: int = 1_000_000
) -> tuple[DataFrame, int]:
    """Every distinct term of the text columns with its occurrences and records, and the number of records with a term.

    A record is a row; its columns count together.  Null, empty and blank texts have
    no terms; repeated rows count again; extra columns are ignored; an empty table
    gives no terms and 0.

    capacity: terms a trie node holds before it bursts.  fanout, depth: bound the
    open prefixes to fanout * depth.  most_terms: distinct terms after which a task
    hands over its trie and starts a new one.
    """
    leaves = materialise(texts.select(*columns).mapInArrow(local_tries(columns, capacity, most_terms), LEAVES), "tries")
    n_records = leaves.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    leaves = leaves.filter(F.col("prefix").isNotNull()).select("prefix", "suffixes", "occurrences", "records")
    heads = leaves.select("prefix", F.size("suffixes").cast("bigint").alias("load"))
    total = heads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    levels = heads.select(
        F.explode(F.expr(f"transform(sequence(1, least(length(prefix), {depth})), i -> left(prefix, i))")).alias("prefix"), "load"
    ).filter("length(prefix) > 0")
    hot = levels.groupBy("prefix").agg(F.sum("load").alias("load")).filter(F.col("load") > total / fanout)
    opened = frozenset(r[0] for r in hot.select("prefix").collect())  # at most fanout * depth rows
    routes = leaves.mapInArrow(routed(opened), "route string, prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>")
    return routes.repartition("route").sortWithinPartitions("route").mapInArrow(merged(capacity), MERGED), int(n_records)
