"""Sentence boundaries by a hidden-event n-gram model.

Between any two words of a line (any two signs in scripts without blanks) stands a
slot, where a hidden boundary token may follow.  The model is an n-gram model over
words and boundary tokens: the probability of the token after the last two words and
the terminator between them and it, and how likely the next word is behind the token
and behind none; contexts too rare to count back off to shorter ones and to the
words' shapes.  A writer who ends sentences with terminators does so throughout a
line, so in such lines only the slots behind a terminator are open; in a line
without any, every slot is, with the terminator left out of the context.

The model is trained without labels and without word lists: line ends and line starts
are sure boundaries, a word that ends sentences must also end its share of lines, and
expectation maximisation spreads this to the slots inside lines.  Decoding runs
forward and backward over a line's slots, with the length of the sentence between two
boundaries as transition, and takes a boundary where its posterior is above one half.

Quotations and brackets that close inside a line are running parts of its
sentences: their inner slots never part.  Line ends always part, and in Thai blanks.

Texts are cut into slots once; slots are kept as numbers (places and hashes of their
contexts).  Counting, the rounds of training and decoding then run on arrays.  The
counts of all rows are added up by Spark; what the model keeps of them are sorted
hash arrays, sent to every task: broadcast, or as mapped files where they are large.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.llm import tables
from lexifold.runtime import materialise

LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_ENDS = ".!?。！？｡．।॥؟۔…"
_MARKS = r"\[\d[\d,;\s–-]*\]|[¹²³⁰⁴-⁹]+"
CLUSTER = re.compile(rf"[{_ENDS}]+((?:[\"'”’»)\]}}」』）】》〉›]|[   ]»|{_MARKS})*)")
CLUSTER_LOW = re.compile(rf"[{_ENDS}]+((?:[\"'”’»)\]}}」』）】》〉›“‘]|[   ]»|{_MARKS})*)")  # „quoted like this“
PAIRED = re.compile(r"[\"“”„«»()\[\]{}（）「」『』【】《》〈〉]")
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»"}
_CLOSE = set(_OPEN.values())
_SURE = "。！？｡।॥؟۔"  # terminators that stand for nothing else
_TIGHT = _SURE + "．…"  # terminators that need no blank behind them

HAN = re.compile(r"[぀-ヿ㐀-鿿]")
SCRIPTS = (("Thai", re.compile(r"[฀-๿]")), ("Han", HAN), ("Deva", re.compile(r"[ऀ-ॿ]")), ("Arab", re.compile(r"[؀-ۿ]")), ("Cyrl", re.compile(r"[Ѐ-ӿ]")))

def script(line: str) -> str:
    """The script of a line: the first of the caseless or Cyrillic scripts it holds, else Latn."""
    if line.isascii():
        return "Latn"
    for name, pattern in SCRIPTS:
        if pattern.search(line):
            if name == "Thai":
                thai = sum("฀" <= c <= "๿" for c in line)
                if thai * 4 < sum(c.isalpha() for c in line):
                    continue
            return name
    return "Latn"


@lru_cache(maxsize=1 << 16)
def shape(word: str, kind: str) -> str:
    """What a rare word counts as."""
    first = word[0]
    if first.isdigit():
        return f"0@{kind}"
    if HAN.match(first):
        return f"H{first}"
    if not first.isalpha():
        return first
    if "." in word:
        return "a.b"
    if len(word) == 1:
        return "I" if first.isupper() else "i"
    if any(c.isdigit() for c in word) and (first.islower() and not word[1:].islower() or word.upper() == word):
        return "a1" if first.islower() and word[1].isdigit() else "AB1" if first.isupper() else "aB1"
    if first.isupper():
        return "AB" if word.isupper() else f"Ab@{kind}"
    return f"ab@{kind}" if first.islower() else f"x@{kind}"


@dataclass(slots=True)
class Slot:
    end: int  # of the closed cluster
    w0: str
    w1: str
    mark: str
    next: str  # "" at the line's end
    gap: int  # words since the last slot or the line's start


def closed_spans(line: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that open and close in the line."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in PAIRED.finditer(line):
        c, at = m.group(), m.start()
        if c in _OPEN:
            stack.append((_OPEN[c], at))
            continue
        if c == '"' and not any(w == '"' for w, _ in stack):
            stack.append(('"', at))
            continue
        if c == "„" or c == "“" and not any(w == "“” " for w, _ in stack):
            stack.append(("“” " if c == "„" else "”", at))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if c in stack[i][0]:
                spans.append((stack[i][1], at))
                del stack[i:]
                break
    spans.sort()
    outer: list[tuple[int, int]] = []
    for first, last in spans:
        if not outer or first > outer[-1][1]:
            outer.append((first, last))
    return outer


def _number(word: str) -> str:
    """Numbers by their form only."""
    return ("0.0" if "." in word or "," in word else "0" if len(word) <= 2 else "00") if word[0].isdigit() else word


def _before(text: str) -> tuple[str, str]:
    """The last two words of a text without what opens or closes them; in Han script its last two signs, and nothing."""
    if not text:
        return "", ""
    if HAN.match(text[-1]):
        return "", text[-2:]
    *_, w0, w1 = ("", "", *text.rsplit(None, 2)[-2:])
    w1 = _bare(w1)
    for k in range(len(w1) - 1, -1, -1):
        if HAN.match(w1[k]):  # a foreign word inside Han script
            w0, w1 = w1[max(0, k - 1) : k + 1], w1[k + 1 :]
            break
    w0 = _bare(w0)
    return _number(w0) if w0 else "", _number(w1) if w1 else text[-1]


_EDGES = "\"'“”„«»‘’()[]{}（）「」『』【】《》,;:.!?…¿¡，；：、—–-*|"
AFTER = re.compile(r"[\s\"“„«(（「『【¿¡\[《]*(\S*)")


_STOPS = set(_ENDS + "\"'”’»)]")


def _bare(word: str) -> str:
    return word.strip(_EDGES)


def _after(text: str) -> str:
    """The first word of a text behind what opens it; its first two signs in Han script."""
    word = AFTER.match(text).group(1)
    if not word:
        return ""
    if HAN.match(word):
        return word[:2]
    m = HAN.search(word)
    bare = _bare(word[: m.start()] if m else word)
    return _number(bare) if bare else word[0]


def slots(line: str, kind: str) -> list[Slot]:
    """The slots of a line; the last one is the line's end if a cluster ends it."""
    spans = closed_spans(line)
    out: list[Slot] = []
    last = 0
    for m in (CLUSTER_LOW if "„" in line else CLUSTER).finditer(line):
        start, end = m.span()
        if any(first < end <= close for first, close in spans):
            continue
        rest = line[end : end + 48]
        final = not rest or rest.isspace() and not line[end:].strip()
        if not final and not rest[0].isspace():
            mark = m.group()[0]
            tight = any(c in _TIGHT for c in m.group()) or mark in "!?" and HAN.match(rest)
            glued = rest[0].isupper() and rest[1:2].islower() and (m.group(1) or mark in "!?" or re.search(r"[^\W_]{2}$", line[max(0, start - 2) : start]) and "." not in line[:start].rsplit(None, 1)[-1][:-1])
            if not (tight or glued):
                continue
        w0, w1 = _before(line[max(last, start - 64) : start].rstrip())
        mark = m.group()[0] if len(m.group()) == len(m.group(1)) + 1 else m.group()[:2]
        gap = len(line[last:start].split()) if kind != "Han" else (start - last + 1) // 2
        out.append(Slot(end, w0, w1, mark + ("'" if m.group(1) else ""), "" if final else _after(rest), gap))
        last = end
    return out


def lines(text: str | None) -> Iterator[tuple[int, str]]:
    if text:
        for m in LINE.finditer(text):
            if not m.group().isspace():
                yield m.start(), m.group()


OPEN_WORDS, OPEN_SIGNS = 12, 24  # from which length on a line without terminators can hold several sentences
MARKED, UNMARKED, CERTAIN, END = 0, 1, 2, 3  # kinds of slots


def open_slots(line: str, kind: str) -> list[tuple[int, int, str, str, int]]:
    """Slots between all words (signs in Han script) of a line without terminators: end, next start, words before and behind, gap."""
    spans = closed_spans(line)
    inside = lambda at: any(first < at <= close for first, close in spans)
    out = []
    if kind == "Han":
        signs = [m.start() for m in re.finditer(r"\S", line)]
        if len(signs) < OPEN_SIGNS:
            return []
        for n, (before, at) in enumerate(zip(signs, signs[1:]), 1):
            if n > 1 and not inside(at) and line[at] not in _EDGES and HAN.match(line[at]) and HAN.match(line[before]):
                out.append((before + 1, at, line[before - 1 : before + 1], line[at : at + 2], 1))
        return [(e, a, w, x, 0 if i else 1) for i, (e, a, w, x, _) in enumerate(out)]
    words = list(re.finditer(r"\S+", line))
    if len(words) < OPEN_WORDS:
        return []
    for before, word in zip(words, words[1:]):
        w1, behind = _bare(before.group()), _bare(word.group())
        if w1 and behind and not inside(word.start()) and before.group()[-1] not in ",;:":
            out.append((before.end(), word.start(), _number(w1), _number(behind), 1))
        else:
            out.append((before.end(), word.start(), "", "", 1))
    return out


@lru_cache(maxsize=1 << 17)
def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1  # 63 bits


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


#: A slot's kind, edges, contexts as hashes, gap.
_SLOTS = {"sort": "i1", "prior": "i1", "gap": "i1", "end": "i4", "after": "i4", "mark": "i8", "w0": "i8", "w1": "i8", "s1": "i8", "nx": "i8", "sn": "i8"}
_PRIORS = np.array([0.3, 0.7, 0.995, 0.9])  # before anything is seen: behind …, behind closed quotes, sure terminators, others
_SURE_PRIOR = 2


def _prior(mark: str) -> int:
    return 0 if mark[0] == "…" else 1 if mark[-1] == "'" else 2 if mark[0] in _SURE else 3


class Words:
    """Counts of words behind a line's start and inside lines, gathered as strings and handed on as hashes."""

    def __init__(self) -> None:
        self.starts, self.mids = Counter(), Counter()  # by (word, script) and by script: word
        self.signs: Counter = Counter()

    def line(self, line: str, kind: str, closed: bool) -> None:
        if closed and (first := _after(line)):
            self.starts[first, kind] += 1
        if kind == "Han":
            self.signs.update(line[k : k + 2] for k in range(1, len(line) - 1) if line[k - 1] not in "。！？")
        else:
            words = line.split()
            held = self.mids.get(kind)
            if held is None:
                held = self.mids[kind] = Counter()
            held.update([w for b, w in zip(words, words[1:]) if b[-1] not in _STOPS])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes with starts and mids: of the word, of its lower case, and of its shape."""
        found: dict[int, list[int]] = {}

        def add(word: str, kind: str, column: int, n: int) -> None:
            for h in (_hash(word), _hash("~" + word.lower()), _hash(f"@{shape(word, kind)}")):
                found.setdefault(h, [0, 0])[column] += n

        for (word, kind), n in self.starts.items():
            add(word, kind, 0, n)
        for kind, held in self.mids.items():
            for word, n in held.items():
                if bare := _bare(word):
                    add(_number(bare), kind, 1, n)
        for word, n in self.signs.items():
            add(word, "Han", 1, n)
        counts = np.array(list(found.values()), np.int64).reshape(len(found), 2)
        return np.array(list(found), np.int64), counts[:, 0], counts[:, 1]

    def size(self) -> int:
        return len(self.starts) + len(self.signs) + sum(map(len, self.mids.values()))


class Cut:
    """Texts' lines and slots as numbers."""

    def __init__(self) -> None:
        self.texts: list[int] = []  # lines of each
        self.lines: list[tuple[int, int, int]] = []  # start, end, slots
        self.slots: list[tuple[int, ...]] = []  # in the order of _SLOTS

    def add(self, text: str | None, words: Words | None = None) -> bool:
        """Cut a text; one without lines leaves nothing."""
        rows, n_lines = self.slots, len(self.lines)
        for at, line in lines(text):
            kind = script(line)
            first = len(line) - len(line.lstrip())
            last = len(line.rstrip())
            n = len(rows)
            if kind == "Thai":
                closed = closed_spans(line)
                for m in re.finditer(r"\s+", line):
                    if first < m.start() < last and not any(a < m.start() < b for a, b in closed):
                        rows.append((CERTAIN, 3, 6, at + m.start(), at + m.end(), 0, 0, 0, 0, 0, 0))
            else:
                found = slots(line, kind)
                for s in found:
                    context = (_hash(s.mark), _hash(s.w0), _hash(s.w1), _hash("@" + (shape(s.w1, kind) if s.w1 else "")))
                    if not s.next:
                        rows.append((END, _prior(s.mark), min(s.gap, 6), at + s.end, 0, *context, 0, 0))
                        continue
                    behind = s.end
                    while behind < last and line[behind].isspace():
                        behind += 1
                    rows.append((MARKED, _prior(s.mark), min(s.gap, 6), at + s.end, at + behind, *context, _hash(s.next), _hash("@" + shape(s.next, kind))))
                if not found:
                    cased = any(c.isupper() for c in line[first + 1 :])
                    for end, after, w1, behind, gap in open_slots(line, kind):
                        if not w1:
                            rows.append((UNMARKED, 3, gap, at + end, at + after, 0, 0, 0, 0, 0, 0))
                            continue
                        # A word of a script with case counts in lower case, and its own case beside, where the line has any.
                        case = behind.lower() != behind.upper()
                        exact = (_hash(behind), _hash("@" + shape(behind, kind))) if case and cased else (0, 0)
                        rows.append((UNMARKED, 3, gap, at + end, at + after, 0, _hash("~" + behind.lower() if case else behind), _hash(w1), 0, *exact))
                if words is not None:
                    words.line(line, kind, bool(found) and not found[-1].next)  # a line that isn't closed is a heading
            self.lines.append((at + first, at + last, len(rows) - n))
        if len(self.lines) > n_lines:
            self.texts.append(len(self.lines) - n_lines)
        return len(self.lines) > n_lines

    def packed(self) -> bytes:
        """All arrays behind each other."""
        columns = list(zip(*self.slots)) or [()] * len(_SLOTS)
        arrays = [np.array([len(self.texts), len(self.lines), len(self.slots)], "i8"), np.array(self.texts, "i4"), np.array(self.lines, "i4").reshape(-1, 3).T]
        return b"".join(x.tobytes() for x in arrays + [np.array(c, t) for c, t in zip(columns, _SLOTS.values())])


_HELD = 300_000  # words a task holds before it hands them on


def surveyed(key: str, columns: list[str], whole: bool):
    """Map task: slices of texts to their keys, parts, slots (and themselves, if ``whole``), and rows of counted words."""
    names = ["_keys", "_parts", "_texts", "slots", "word", "starts", "mids"]

    def counted(words: Words, key_type: pa.DataType) -> pa.RecordBatch:
        found, starts, mids = words.rows()
        none = [pa.nulls(len(found), t) for t in (pa.list_(key_type), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary())]
        return pa.record_batch([*none, pa.array(found), pa.array(starts), pa.array(mids)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key_type = Words(), None
        for batch in batches:
            key_type = batch.column(key).type
            for first in range(0, batch.num_rows, 500):
                keys, parts, texts, found = [], [], [], Cut()
                own = batch.slice(first, 500)
                for identity, *fields in zip(*(own.column(c).to_pylist() for c in (key, *columns))):
                    for part, text in zip(columns, fields):
                        if found.add(text, words):
                            keys.append(identity), parts.append(part), texts.append(text if whole else None)
                if keys:
                    lists = [pa.array([keys], pa.list_(key_type)), pa.array([parts], pa.list_(pa.string())), pa.array([texts if whole else None], pa.list_(pa.string()))]
                    yield pa.record_batch([*lists, pa.array([found.packed()], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], names=names)
                if words.size() > _HELD:
                    yield counted(words, key_type)
                    words = Words()
        if words.size():
            yield counted(words, key_type)

    return task


class Slots:
    """The slots of cut texts as arrays."""

    def __init__(self, packed: bytes) -> None:
        at = 24
        n_texts, n_lines, n_slots = np.frombuffer(packed, "i8", 3)

        def taken(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(packed, kind, n, at)
            at += out.nbytes
            return out

        texts = taken("i4", n_texts)
        self.line_start, self.line_end, self.line_slots = (taken("i4", n_lines).astype(np.int64) for _ in range(3))
        self.text_of_line = np.repeat(np.arange(n_texts), texts)
        self.line = np.repeat(np.arange(n_lines), self.line_slots)
        self.first = np.cumsum(self.line_slots) - self.line_slots
        for name, kind in _SLOTS.items():
            setattr(self, name, taken(kind, n_slots))
        self.l2s, self.l2w = _mixed(self.mark, self.s1), _mixed(self.mark, self.w1)
        self.l3 = _mixed(self.l2w, self.w0)

    def left(self) -> tuple[np.ndarray, ...]:
        """A slot's contexts on its left, from the shortest on."""
        return self.mark, self.l2s, self.l2w, self.l3


_PLAIN_MARKS = tuple(_hash(m) for m in ".!?" + _SURE)  # a word's boundaries behind any of these are those without


@dataclass
class Model:
    """Sorted hash arrays of contexts and of words, what is known of them, and of sentences' lengths."""

    contexts: np.ndarray
    yes: np.ndarray  # expected boundaries
    seen: np.ndarray
    ends: np.ndarray  # at lines' ends
    words: np.ndarray
    behind: np.ndarray  # behind a boundary
    other: np.ndarray  # and behind none
    scale: float = 1.0
    rate: float = 1.0
    length: np.ndarray | None = None  # log factor by words

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted keys; the last place, which holds nothing, for those not kept."""
        if len(keys) == 1:
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys[:-1], wanted), len(keys) - 2)
        return np.where(keys[at] == wanted, at, len(keys) - 1)

    def left_odds(self, found: Slots, at: tuple[np.ndarray, ...]) -> np.ndarray:
        p = _PRIORS[found.prior]
        for places, weight in zip(at, (20.0, 4.0, 3.0, 2.0)):
            p = (self.yes[places] + weight * p) / (self.seen[places] + weight)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def next_odds(self, word: np.ndarray, shape_: np.ndarray) -> np.ndarray:
        ratio = (self.behind[shape_] + self.scale) / (self.other[shape_] + 1.0)
        return np.clip(np.log((self.behind[word] + 2 * ratio) / (self.other[word] + 2) / self.scale), -6.0, 6.0)

    def marked_odds(self, found: Slots, left: tuple[np.ndarray, ...], word: np.ndarray, shape_: np.ndarray) -> np.ndarray:
        """Log odds of a boundary by both sides; a terminator of its own kind outweighs a next word that is seldom first."""
        b = self.next_odds(word, shape_)
        return self.left_odds(found, left) + np.where(found.prior == _SURE_PRIOR, np.maximum(b, -3.0), b)

    def unmarked_odds(self, found: Slots) -> np.ndarray:
        """Log odds in lines without terminators: how often the word ends sentences against its occurrences, how often the next starts them."""
        ends = sum(self.yes[self._at(self.contexts, _mixed(np.full(len(found.w1), mark), found.w1))] for mark in _PLAIN_MARKS)
        own = self._at(self.words, found.w1)
        usual = min(0.5, self.scale)
        p = (ends + 2 * usual) / (ends + self.other[own] + self.behind[own] + 2)
        folded = self._at(self.words, found.w0)
        b = np.log((self.behind[folded] + 2 * self.scale) / (self.other[folded] + 2) / self.scale)
        cased = np.where(found.nx != 0, np.maximum(0.0, self.next_odds(self._at(self.words, found.nx), self._at(self.words, found.sn))), 0.0)
        odds = np.log(p / (1 - p)) + np.clip(b, -6.0, 6.0) + 0.5 * cased
        return np.where(found.w1 != 0, odds, -40.0)

    def odds(self, found: Slots) -> np.ndarray:
        left = tuple(self._at(self.contexts, k) for k in found.left())
        marked = self.marked_odds(found, left, self._at(self.words, found.nx), self._at(self.words, found.sn))
        unmarked = self.unmarked_odds(found) if (found.sort == UNMARKED).any() else 0.0
        return np.select([found.sort == MARKED, found.sort == UNMARKED], [marked, unmarked], 40.0)


def _lengths(gaps: np.ndarray) -> np.ndarray:
    total = gaps.sum() or 1
    b = np.arange(7)
    return np.where(gaps / total < 0.5, np.log(np.maximum(0.02, 1 - 1.6 * np.exp(-b))), 0.0)


def boundaries(found: Slots, model: Model) -> np.ndarray:
    """Forward-backward over all lines at once; True where a boundary's posterior is above one half."""
    odds = np.clip(model.odds(found), -40.0, 40.0)
    e, close = np.exp(odds), np.exp(model.length[found.gap])
    n_lines = len(found.line_slots)
    out = np.zeros(len(odds), bool)
    forward = np.zeros((2, len(odds)))
    yes, no = np.ones(n_lines), np.zeros(n_lines)  # at the line's start
    most = int(found.line_slots.max(initial=0))
    order = np.argsort(-found.line_slots, kind="stable")  # longest lines first: those with a k-th slot are a beginning
    counts = np.bincount(found.line_slots, minlength=most + 1)
    active = n_lines - np.cumsum(counts)  # lines with more than k slots
    for k in range(most):
        own = order[: active[k]]
        at = found.first[own] + k
        a, b = e[at] * (yes[own] * close[at] + no[own]), yes[own] + no[own]
        yes[own], no[own] = a / (a + b), b / (a + b)
        forward[0, at], forward[1, at] = yes[own], no[own]
    yes, no = np.ones(n_lines), np.ones(n_lines)
    for k in range(most - 1, -1, -1):
        own = order[: active[k]]
        at = found.first[own] + k
        out[at] = forward[0, at] * yes[own] > forward[1, at] * no[own]
        a, b = e[at] * close[at] * yes[own] + no[own], e[at] * yes[own] + no[own]
        yes[own], no[own] = a / (a + b), b / (a + b)
    return out


def sentence_edges(found: Slots, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences in order: the text's place in the batch, start and end."""
    chosen = boundaries(found, model) & (found.sort != END)
    inner = found.text_of_line[found.line[chosen]]
    of_text = np.concatenate([found.text_of_line, inner])
    starts = np.concatenate([found.line_start, found.after[chosen].astype(np.int64)])
    ends = np.concatenate([found.line_end, found.end[chosen].astype(np.int64)])
    by_start, by_end = np.lexsort((starts, of_text)), np.lexsort((ends, of_text))
    return of_text[by_start], starts[by_start], ends[by_end]


def spans(text: str | None, model: Model) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence of a text, in code points."""
    found = Cut()
    if found.add(text):
        _, starts, ends = sentence_edges(Slots(found.packed()), model)
        yield from zip(starts.tolist(), ends.tolist())


# --- training --------------------------------------------------------------------

_SUMS = "kind string, hash bigint, a double, b double"


def _summed(kind: str, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    own, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, weights=x, minlength=len(own)) for x in (a, b)]
    return pa.record_batch([pa.array([kind] * len(own), pa.string()), pa.array(own), *map(pa.array, sums)], names=["kind", "hash", "a", "b"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Slots]:
    for batch in batches:
        for packed in batch.column("slots"):
            yield Slots(packed.as_buffer().to_pybytes())


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: cut texts to their contexts' slots inside lines (a) and at lines' ends (b), and the lengths between."""
    for found in _read(batches):
        inside, ends = found.sort == MARKED, found.sort == END
        either = inside | ends
        for keys in found.left():
            yield _summed("left", keys[either], inside[either].astype(float), ends[either].astype(float))
        for keys in (found.nx, found.sn):
            yield _summed("next", keys[inside], np.ones(int(inside.sum())), np.zeros(int(inside.sum())))
        yield _summed("gap", found.gap[either].astype(np.int64), np.ones(int(either.sum())), np.zeros(int(either.sum())))
        yield _summed("total", np.zeros(len(either), np.int64), inside.astype(float), ends.astype(float))


def expected(sent):
    """Map task: cut texts to the boundaries their slots are expected to hold, by places in the model's arrays.

    A task adds up its texts' sums in arrays as large as the model's, unless those are
    mapped; then it hands on those of every slice of texts.
    """

    def summed(kind: str, places: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        return _summed(kind, *(np.concatenate(x) for x in (places, a, b)))

    def sparse(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _read(batches):
            inside = found.sort == MARKED
            at = tuple(model._at(model.contexts, k) for k in found.left())
            word, shape_ = model._at(model.words, found.nx), model._at(model.words, found.sn)
            p = 1 / (1 + np.exp(-model.marked_odds(found, at, word, shape_)[inside]))
            yield summed("left", [places[inside] for places in at], [p] * len(at), [np.zeros_like(p)] * len(at))
            yield summed("word", [word[inside], shape_[inside]], [p] * 2, [1 - p] * 2)
            yield summed("total", [np.zeros(len(p), np.int64)], [p], [1 - p])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        if isinstance(model.contexts, np.memmap) or isinstance(model.words, np.memmap):
            yield from sparse(model, batches)
            return
        left, next_, total = np.zeros(len(model.contexts)), np.zeros((2, len(model.words))), np.zeros(2)
        for found in _read(batches):
            inside = found.sort == MARKED
            at = tuple(model._at(model.contexts, k) for k in found.left())
            word, shape_ = model._at(model.words, found.nx), model._at(model.words, found.sn)
            p = 1 / (1 + np.exp(-model.marked_odds(found, at, word, shape_)[inside]))
            for places in at:
                left += np.bincount(places[inside], weights=p, minlength=len(left))
            for places in (word, shape_):
                next_[0] += np.bincount(places[inside], weights=p, minlength=next_.shape[1])
                next_[1] += np.bincount(places[inside], weights=1 - p, minlength=next_.shape[1])
            total += p.sum(), (1 - p).sum()
        for kind, a, b in (("left", left, np.zeros_like(left)), ("word", *next_), ("total", total[:1], total[1:])):
            there = np.flatnonzero((a != 0) | (b != 0))
            yield pa.record_batch([pa.array([kind] * len(there), pa.string()), pa.array(there.astype(np.int64)), pa.array(a[there]), pa.array(b[there])], names=["kind", "hash", "a", "b"])

    return task


def _kept(counts: DataFrame, least: float, most: int | None, held: int) -> list[np.ndarray]:
    """Sorted hashes with both counts of the entries with ``n`` of ``least`` (doubled until at most ``most`` remain, if that is given), and a place for all others."""
    while most is not None and counts.filter(F.col("n") >= least).count() > most:
        least *= 2
    return tables.looked_up(counts.filter(F.col("n") >= least), ["a", "b"], np.float64, held, spare=1)


def learnt(survey: DataFrame, rounds: int = 4, least: float = 2.0, most: int | None = None, held: int = 2_000_000) -> Model:
    """Expectation maximisation over all cut texts of a survey.

    Every row is counted, and every round runs over all rows.  What the model keeps are
    all contexts and words seen ``least`` times (once says nothing that backing off
    doesn't).  Up to ``held`` of either (24 bytes apiece) are in memory; more are in
    mapped files, with the same results.  Only a caller who gives ``most`` gets a smaller
    model, whose least frequent entries back off to their shorter contexts and shapes.
    """
    spark = survey.sparkSession
    cut_ = survey.filter(F.col("slots").isNotNull()).select("slots")
    counts = materialise(cut_.mapInArrow(contexts, _SUMS).groupBy("kind", "hash").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "contexts")
    words = survey.filter(F.col("word").isNotNull()).select(F.col("word").alias("hash"), F.col("starts").alias("a"), F.col("mids").alias("b"), (F.col("starts") + F.col("mids")).alias("n"))
    behind_slots = counts.filter("kind = 'next'").select("hash", F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("a").alias("n"))
    words = words.unionByName(behind_slots).groupBy("hash").agg(*(F.sum(c).cast("double").alias(c) for c in ("a", "b", "n")))
    words = materialise(words, "words")
    gaps = np.zeros(7)
    inside = total_ends = 0.0
    for kind, key, a, b in counts.filter("kind IN ('gap', 'total')").collect():  # at most eight rows
        if kind == "gap":
            gaps[key] = a
        else:
            inside, total_ends = a, b
    rate = max(1.0, inside / total_ends) if total_ends else 1.0  # boundaries at slots are so many times as frequent as at lines' ends
    keys, seen, ends = _kept(counts.filter("kind = 'left'").withColumn("n", F.col("a") + F.col("b")), least, most, held)
    names, starts, mids = _kept(words, least, most, held)
    mapped, mapped_words = isinstance(keys, np.memmap), isinstance(names, np.memmap)
    # Each word is counted as itself, in lower case and as its shape.
    started, stayed = (max(1.0, (x or 0) / 3) for x in words.agg(F.sum("a"), F.sum("b")).first())
    enough = 4 * rate  # slots from which on a word that is never at a line's end says something
    sure = np.array([_hash(m) for m in _SURE], np.int64)
    yes, known = (tables.zeros(len(keys), np.float64, mapped) for _ in range(2))
    for at in tables.slices(len(keys)):
        told = ((seen[at] >= enough) | (ends[at] > 0)) & ~np.isin(keys[at], sure)
        yes[at] = np.where(told, np.minimum(seen[at], ends[at] * rate), 0.0)
        known[at] = np.where(told, seen[at], 0.0)
    model = Model(keys, yes, known, ends, names, starts, mids, started / stayed, rate, _lengths(gaps))
    for _ in range(rounds):
        sent = tables.send(spark, model)
        sums = materialise(cut_.mapInArrow(expected(sent), _SUMS).groupBy("kind", "hash").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "expected")  # no more rows than the model
        sent.destroy()
        yes = tables.zeros(len(keys), np.float64, mapped)
        behind, other = (tables.zeros(len(names), np.float64, mapped_words) for _ in range(2))
        tables.scattered(sums.filter("kind = 'left'"), [yes], ["a"])
        tables.scattered(sums.filter("kind = 'word'"), [behind, other], ["a", "b"])
        # A word that is never at a line's end can't be at every sentence's; chance is allowed for.
        for at in tables.slices(len(keys)):
            yes[at] = np.where(seen[at] >= enough, np.minimum(yes[at], (ends[at] + 1.5) * rate * 3), yes[at])
        for at in tables.slices(len(names)):
            behind[at] += starts[at]
            other[at] += mids[at]
        for array in (yes, behind, other):
            array[-1] = 0  # the place of what isn't kept
        # Behind a slot inside a line counts as behind the line's end.
        total = sums.filter("kind = 'total'").agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
        scale = (started + total[0]) / (stayed + total[1])
        model = Model(keys, yes, seen, ends, names, behind, other, float(scale), rate, model.length)
    return model


def fit(texts: DataFrame, key: str, columns: list[str]) -> Model:
    """The model of all rows."""
    return learnt(materialise(_surveyed(texts, key, columns, False), "slots"))


def _surveyed(texts: DataFrame, key: str, columns: list[str], whole: bool) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, *columns).mapInArrow(surveyed(key, columns, whole), f"_keys array<{kind}>, _parts array<string>, _texts array<string>, slots binary, word bigint, starts bigint, mids bigint")


def sentences(texts: DataFrame, key: str, columns: list[str], model: Model | None = None, whole: bool = True) -> DataFrame:
    """One row per sentence: key, part, sentence_no (from 0 in its part), start_pos, end_pos, sentence (unless ``whole`` is False).

    Offsets count code points; the end is exclusive and no blank stands at either
    edge.  Null, empty and blank texts give no rows; repeated rows give theirs each;
    other columns are ignored; an empty table gives an empty result.  Without a
    ``model`` one is learnt from all rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, part string, sentence_no bigint, start_pos bigint, end_pos bigint" + (", sentence string" if whole else "")
    held = _surveyed(texts, key, columns, whole)
    if model is None:
        held = materialise(held, "slots")
        model = learnt(held)
    sent = tables.send(texts.sparkSession, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                keys, parts = (batch.column(c).slice(row, 1).flatten() for c in ("_keys", "_parts"))
                of_text, starts, ends = sentence_edges(Slots(batch.column("slots")[row].as_py()), own_model)
                new = np.concatenate([[True], of_text[1:] != of_text[:-1]]) if len(of_text) else np.empty(0, bool)
                number = np.arange(len(of_text)) - np.maximum.accumulate(np.where(new, np.arange(len(of_text)), 0))
                at = pa.array(of_text)
                out = [keys.take(at), parts.take(at), pa.array(number), pa.array(starts), pa.array(ends)]
                if whole:
                    own = batch.column("_texts")[row].as_py()
                    out.append(pa.array([own[t][a:b] for t, a, b in zip(of_text.tolist(), starts.tolist(), ends.tolist())], pa.string()))
                yield pa.record_batch(out, names=[key, "part", "sentence_no", "start_pos", "end_pos", *["sentence"] * whole])

    return held.filter(F.col("slots").isNotNull()).select("_keys", "_parts", *["_texts"] * whole, "slots").mapInArrow(task, schema)
