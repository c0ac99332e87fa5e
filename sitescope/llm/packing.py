"""Best-fit packing of tokenized documents into sequences, after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the packing problem is its histogram: at most ``seq_len`` lengths with their
counts, however many documents there are. That histogram (bounded by seq_len, not by the data) is what the driver gets. On
it the reduction fixes small sets that dominate every other set with their longest piece, as often as both counts allow,
and best fit decreasing places what remains. The outcome is a list of slots: "pieces of length l with rank a to b go to the
sequences from s on, at offset o". Ranks within a length are given out in Spark by counting small buckets; each piece then
finds its slot by a join with the bounded slot table. No piece passes through the driver.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, table, text_of

SEQ_LEN = 2048
SEPARATOR = 0
#: Groups in which the pieces of one length are numbered: so many, or one for each RANK_GROUP pieces.
RANK_GROUPS, RANK_GROUP = 64, 50_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of a byte-level BPE file.

    tiktoken runs the merges several times as fast as the file's own library and gives the same ids (a test compares the
    two on every code point); the library itself takes the texts that tiktoken refuses.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self._fast.encode(text, allowed_special="all"), dtype="<u4")
        except Exception:  # a run that is too long for its pattern matcher
            return np.asarray(self.library().encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the first piece takes what is over."""
    first = (n - 1) % seq_len + 1
    return [(0, first), *[(s, seq_len) for s in range(first, n, seq_len)]]


def pieces(docs: DataFrame, vocabulary: str | None = None, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's ids with the separator behind them.

    Null text is empty and gives one piece with the separator alone; repeated rows give pieces of their own.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in sliced(batches):
            out: list[tuple] = []
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(bpe.ids(text.as_py()), np.uint32(SEPARATOR)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), seq_len)):
                    own = ids[start : start + length]
                    out.append((row.as_py(), k, start, length, zlib.crc32(own.tobytes()), own.astype("int32") if with_ids else None))
            cols = [*zip(*out, strict=True)] or [()] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


# --- the plan, on counts of lengths -------------------------------------------------------------------------------------


def dominate(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixes sets of at most three pieces that dominate all feasible sets with their longest piece.

    For the longest piece j with room r = capacity - j, k the longest other piece that fits into r:
    nothing fits: {j} dominates. k fills r: {j, k} dominates, as whatever else would fill r can trade places with k.
    No two fit into r: {j, k} dominates, as any other single piece is at most k. At most two fit and no pair's sum
    exceeds k: {j, k} dominates. At most two fit and one pair (a, b) is at least as long, piece by piece, as every other
    pair, with a >= k: {j, a, b} dominates. A piece without such a set is left; the next shorter one is tried, and all
    again after a change, as fixed pieces are no longer in the way. Returns (set, times) and what is left.
    """
    left, fixed = {k: v for k, v in counts.items() if v > 0}, []

    def take(found: tuple[int, ...]) -> None:
        times = min(left[x] // found.count(x) for x in set(found))
        fixed.append((found, times))
        for x in found:
            left[x] -= times
        for x in {*found}:
            if not left[x]:
                del left[x]
                keys.pop(bisect.bisect_left(keys, x))

    keys, changed = sorted(left), True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                found = _dominant(j, capacity - j, left, keys)
                if not found:
                    break
                take(found)
                changed = True
    return fixed, left


def _dominant(j: int, room: int, left: dict[int, int], keys: list[int]) -> tuple[int, ...] | None:
    more = lambda x, used=(): left.get(x, 0) - (x == j) - used.count(x) > 0  # noqa: E731  one j is in the set
    at = bisect.bisect_right(keys, room) - 1
    while at >= 0 and not more(keys[at]):
        at -= 1
    if at < 0:
        return (j,)
    k = keys[at]
    if k == room:
        return (j, k)
    small: list[int] = []
    for x in keys[:4]:
        small += [x] * min(3, left[x] - (x == j))
    small = small[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return (j, k)
    if len(small) == 3 and sum(small) <= room:
        return None
    pairs = []
    for i in range(at, -1, -1):
        a = keys[i]
        if not more(a) or a * 2 < small[0] + small[1]:
            continue
        h = bisect.bisect_right(keys, min(a, room - a)) - 1
        while h >= 0 and not more(keys[h], (a,)):
            h -= 1
        if h >= 0:
            pairs.append((a, keys[h]))
    if not pairs or max(a + b for a, b in pairs) <= k:
        return (j, k)
    a, b = max(x[0] for x in pairs), max(x[1] for x in pairs)
    return (j, a, b) if (a, b) in pairs and a >= k else None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: sequences with the same contents are handled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put(capacity - each * length, (length,) * each, n // each)
                put(capacity - n % each * length, (length,) * (n % each), 1 if n % each else 0)
                break
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            full = min(times, n // each)
            put(room - each * length, pattern + (length,) * each, full)
            n -= full * each
            times -= full
            if n < each and times:
                put(room - n * length, pattern + (length,) * n, 1 if n else 0)
                times -= 1 if n else 0
                n = 0
            put(room, pattern, times)
    return [x for group in open_.values() for x in group]


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences)."""
    fixed, left = dominate(counts, seq_len)
    return fixed + best_fit(left, seq_len)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, end, first sequence, offset, pieces of that length in a sequence)."""
    found: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            first = used.get(length, 0)
            used[length] = first + each * times
            found.setdefault(length, []).append((first, used[length], sequence, offset, each))
            offset += each * length
        sequence += times
    return found


def pack(docs: DataFrame, vocabulary: str | None = None, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. An empty table gives no rows."""
    spark = docs.sparkSession
    own = table(pieces(docs, vocabulary, seq_len, with_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most seq_len rows
    groups = max(RANK_GROUPS, sum(counts.values()) // RANK_GROUP)

    own = own.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = own.groupBy("length", "g").agg(F.count("*").alias("n"))
    by = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = table(before.select("length", "g", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before")), "pack-ranks")
    order = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "start", "ids_crc32")
    own = own.withColumn("own", F.row_number().over(order) - 1)
    own = own.join(before, ["length", "g"]).withColumn("rank", F.col("own") + F.col("before"))  # dealt as for the window

    rows = [(length, [tuple(x) for x in xs]) for length, xs in slots(plan(counts, seq_len)).items()]
    shape = "length long, slots array<struct<a: long, b: long, sequence: long, offset: long, each: long>>"
    own = own.join(F.broadcast(spark.createDataFrame(rows, shape)), "length")  # at most seq_len rows
    hit = F.filter("slots", lambda s: (s["a"] <= F.col("rank")) & (F.col("rank") < s["b"]))[0]
    own = own.withColumn("hit", hit)
    within = F.col("rank") - F.col("hit.a")
    return own.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("hit.sequence") + F.floor(within / F.col("hit.each"))).cast("long").alias("sequence_id"),
        (F.col("hit.offset") + within % F.col("hit.each") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of the whole sequence, from ``pack(..., with_ids=True)``. A sequence has at most seq_len ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
