"""Periodic runs of words: repetitions found by a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words with smallest period q, at least max(SHORTEST, EXPONENT * q) long, that no neighbouring word
extends with the same period. A state of the suffix automaton of a word sequence stands for the stretches that end at the
same places; its set of end positions is the union of those of the states that link to it. The sets are merged from the
longest states up, the smaller into the larger, and hold their positions in order. Two positions that become neighbours in the
set of a state at a distance d agree on exactly that state's length of words to their left and on no more: where the length is
at least d this is a square of period d, and it begins where the stretch with that period begins. Seeds with one beginning and
period belong to one run, which reaches to the last of their positions. In a run of exponent four the positions of the last
two periods are neighbours (another position between them would give the run a smaller period), so every run has its seed and
its end, and only smallest periods have any.

A word in a run lies in a window of WINDOW words that recurs a period on or back, and a period is a quarter of the run at
most. So only stretches whose windows recur at no more than a quarter of the stretch's length can hold runs; automata are
built of those, which leaves most prose out. A task holds one slice of texts and one text's automaton.

Special cases: null and empty texts have no words, no runs and collapse to the empty text; very long texts are searched whole
(sets of positions are kept in blocks); equal texts have equal runs; repeated rows are rows of their own; an empty table gives
an empty one; other columns go along whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import sliced, text_of

SHORTEST, EXPONENT, WINDOW = 6, 4, 5
#: Positions in a block of an ordered set at most.
BLOCK = 2048
RUNS = "array<struct<start: long, length: long, period: long>>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Positions:
    """An ordered set of numbers in blocks."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, e: int) -> tuple[int | None, int | None]:
        """Adds a number that is not in the set; its neighbours."""
        k = min(bisect_left(self.tops, e), len(self.tops) - 1)
        block = self.blocks[k]
        at = bisect_left(block, e)
        block.insert(at, e)
        self.size += 1
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else None
        after = block[at + 1] if at + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        self.tops[k] = block[-1]
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.tops[k : k + 1] = [block[BLOCK // 2 - 1], block[-1]]
        return before, after

    def next(self, e: int) -> int | None:
        k = bisect_right(self.tops, e)
        if k == len(self.tops):
            return None
        block = self.blocks[k]
        return block[bisect_right(block, e)]


class Automaton:
    """The suffix automaton of a sequence: length, link and first end position of each state (None for copies)."""

    def __init__(self, sequence: list[int]) -> None:
        self.length, self.link, self.own = [0], [-1], [None]
        length, link, moves, last = self.length, self.link, [{}], 0
        for at, c in enumerate(sequence):
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            self.own.append(at)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(moves[q].copy())
                    self.own.append(None)
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


def seeds(sequence: list[int]) -> Iterator[tuple[int, int, int]]:
    """(beginning, period, last position) of positions that become neighbours in a state long enough for a run."""
    machine = Automaton(sequence)
    sets: list[Positions | None] = [None if e is None else Positions(e) for e in machine.own]
    met: dict[int, list[tuple[int, int]]] = {}
    for state in sorted(range(1, len(sets)), key=machine.length.__getitem__, reverse=True):
        held, length = sets[state], machine.length[state]
        for a, b in met.pop(state, ()):
            if held.next(a) == b:  # no position has come between them
                yield a - length + 1, b - a, b
        up = machine.link[state]
        sets[state] = None
        if up == 0:
            continue
        other = sets[up]
        if other is None:
            sets[up] = held
            continue
        small, large = (held, other) if held.size < other.size else (other, held)
        length, last = machine.length[up], None
        for e in small:
            before, after = large.add(e)
            # Two of the smaller set have met before.
            for a, b in ((before if before != last else None, e), (e, after)):
                if a is not None and b is not None and length >= max(SHORTEST - (b - a), (EXPONENT - 1) * (b - a)):
                    met.setdefault(up, []).append((a, b))
            last = e
        sets[up] = large


def stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that may hold runs. Equal hashes of unequal windows only make a stretch longer."""
    todo = [(0, len(ids))] if len(ids) >= SHORTEST else []
    if not todo:
        return
    h = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - WINDOW + 1 + k].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return
    gap = np.where(same, np.diff(order), len(ids))
    near = np.empty(len(h), dtype=np.int64)
    near[order] = np.minimum(np.r_[gap, len(ids)], np.r_[len(ids), gap])
    while todo:
        lo, hi = todo.pop()
        at = lo + np.flatnonzero(near[lo : hi - WINDOW + 1] <= (hi - lo) // EXPONENT)
        if not at.size:
            continue
        cuts = np.flatnonzero(np.diff(at) > WINDOW) + 1
        found = [(int(p[0]), int(p[-1]) + WINDOW) for p in np.split(at, cuts)]
        found = [(a, b) for a, b in found if b - a >= SHORTEST]
        if found == [(lo, hi)]:
            yield lo, hi
        else:
            todo += found


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(words) - len(numbers) < EXPONENT - 1:  # no word occurs EXPONENT times
        return []
    ends: dict[tuple[int, int], int] = {}
    for lo, hi in stretches(ids):
        for start, period, end in seeds(ids[lo:hi].tolist()):
            ends[lo + start, period] = max(lo + end, ends.get((lo + start, period), 0))
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, without those that any run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return " ".join(w for w, g in zip(words, np.cumsum(gone[:-1]), strict=True) if not g) if runs else " ".join(words)


def find_runs(docs: DataFrame, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, runs, collapsed): the struct of ``columns``, the runs of the whole text and the text without their repetitions."""
    rows = docs.select(F.struct(*columns).alias("doc"), text_of().alias("t"))
    schema = StructType([*rows.select("doc").schema.fields, *StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    item = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found, texts = [], []
            for t in b.column("t"):
                words = _WORD.findall(t.as_py())
                runs = runs_of(words)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(found, pa.list_(item)), pa.array(texts, pa.string())], names=["doc", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null without runs."""
    more = lambda a, b: F.coalesce(b["length"] * a["period"] > a["length"] * b["period"], F.lit(True))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | more(a, b), b).otherwise(a))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tail made periodic in one document of ten, as the query's contract has it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text_of().alias("text"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "text", "g", F.explode(F.array(F.struct(words.alias("w")))).alias("x")).select("doc_id", "text", "g", "x.w")
    n = F.greatest(F.size("w"), F.lit(1))
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    rows = rows.select("doc_id", "text", "w", F.explode(F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")))).alias("x"))
    made = F.transform("w", lambda x, i: F.when(i < F.col("x.a"), x).otherwise(F.get("w", F.col("x.a") + (i - F.col("x.a")) % F.col("x.p"))))
    return rows.select("doc_id", F.when(F.size("w") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Figures and digests of the runs of every document; a null doc_id counts as an empty number."""
    found = find_runs(with_planted_run(docs), ("doc_id",))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.select("doc.doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), listed.alias("listed"), longest(F.col("runs")).alias("best"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return best.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        milli.alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
