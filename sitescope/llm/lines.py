"""Line dedup with sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased; it is held as a 128-bit hash. The state of an
index is three tables in the shared folder:

- postings: every (key, doc_id) once;
- refs: the exact table, for each key the number of its documents and the largest doc_id that holds it;
- filters: for each shard of the key space a cuckoo filter of the keys with at least ``min_docs`` documents.

An insertion or deletion writes only what it changes: further postings with a sign, and new versions of the touched counts.
Tables of BATCHES changes are read together and then written as one. A shard's filter that gets fuller than it was made for
is built anew from the exact table, with room for twice its keys; the others take the changes.

A line has to be looked up in the exact table only if its shard's filter knows it. Cuckoo filters forget, so deleting
documents lowers the counts, takes the keys that are no longer repeated out of the filters, and gives the lines back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, sliced, table, text_of
from .files import new_name, open_store

MIN_CHARS, MIN_DOCS = 20, 3
#: Shards at least, and repeated keys in the filter of a shard, about.
SHARDS, SHARD_KEYS = 16, 500_000
#: Changes after which the tables of an index are written anew as one.
BATCHES = 8
#: Parts into which the postings of a shard are dealt: a line that is in most documents must not meet in one task.
SLICES = 64


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. ``keys`` are pairs of unsigned 64-bit integers (arrays).

    A key's fingerprint comes from its high half, its first bucket from the low half, its second bucket from the first and
    the fingerprint, so that entries can move and be deleted without their keys. What finds no place goes to a stash.
    """

    SLOTS, KICKS = 4, 200
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, capacity: int) -> None:
        need = max(1, int(capacity / (self.SLOTS * 0.8)) + 1)
        self.buckets = np.zeros((1 << (need - 1).bit_length(), self.SLOTS), np.uint16)
        self.stash: dict[tuple[int, int], int] = {}

    def _of(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = ((hi >> np.uint64(48)).astype(np.uint16) | np.uint16(0)).copy()
        print_[print_ == 0] = 1  # zero means empty
        mask = np.uint64(len(self.buckets) - 1)
        a = lo & mask
        return print_, a, a ^ self._jump(print_, mask)

    def _jump(self, print_, mask):
        with np.errstate(over="ignore"):
            return ((print_.astype(np.uint64) * self.MIX) >> np.uint64(20)) & mask

    @property
    def room(self) -> int:
        """Keys for which the filter is made."""
        return int(self.buckets.size * 0.8)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        f, a, b = self._of(hi, lo)
        found = (self.buckets[a] == f[:, None]).any(1) | (self.buckets[b] == f[:, None]).any(1)
        if self.stash:
            found |= np.fromiter(((int(x), int(min(y, z))) in self.stash for x, y, z in zip(f, a, b, strict=True)), bool, len(f))
        return found

    def _slots(self, at: np.ndarray, f: np.ndarray, free: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each entry a slot of its own in its bucket that is free (or holds its fingerprint), and whether there is one."""
        order = np.lexsort((f, at)) if not free else np.argsort(at, kind="stable")
        a, g = at[order], f[order]
        new = np.r_[True, (a[1:] != a[:-1]) | ((g[1:] != g[:-1]) & (not free))][: len(a)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        fits = self.buckets[a] == (0 if free else g[:, None])
        chosen = fits & (fits.cumsum(1) == (np.arange(len(a)) - first + 1)[:, None])
        slot, found = np.empty(len(a), np.int64), np.empty(len(a), bool)
        slot[order], found[order] = chosen.argmax(1), chosen.any(1)
        return slot, found

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """All entries at once where a bucket of theirs has room; the others move entries about, one by one."""
        mask = np.uint64(len(self.buckets) - 1)
        f, a, b = self._of(hi, lo)
        for side in (0, 1):
            at = (a, b)[side]
            slot, found = self._slots(at, f, True)
            self.buckets[at[found], slot[found]] = f[found]
            f, a, b = f[~found], a[~found], b[~found]
        for f, a in zip(f, a, strict=True):
            at = a
            for kick in range(self.KICKS):
                slot = (int(f) + kick) % self.SLOTS
                f, self.buckets[at, slot] = self.buckets[at, slot], f
                at = at ^ self._jump(f, mask)
                if self._put(at, f):
                    break
            else:
                key = (int(f), int(min(at, at ^ self._jump(f, mask))))
                self.stash[key] = self.stash.get(key, 0) + 1

    def _put(self, at, f) -> bool:
        free = np.flatnonzero(self.buckets[at] == 0)
        if len(free):
            self.buckets[at, free[0]] = f
        return len(free) > 0

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes one entry of each key out; only keys that were inserted may be deleted."""
        f, a, b = self._of(hi, lo)
        for side in (0, 1):
            at = (a, b)[side]
            slot, found = self._slots(at, f, False)
            self.buckets[at[found], slot[found]] = 0
            f, a, b = f[~found], a[~found], b[~found]
        for x, y, z in zip(f, a, b, strict=True):
            key = (int(x), int(min(y, z)))
            if self.stash.get(key, 0) > 1:
                self.stash[key] -= 1
            else:
                self.stash.pop(key, None)

    def to_bytes(self) -> bytes:
        extra = np.array([[*k, n] for k, n in self.stash.items()], np.int64).reshape(-1, 3)
        return len(self.buckets).to_bytes(8, "little") + self.buckets.tobytes() + extra.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        own, n = cls(1), int.from_bytes(data[:8], "little")
        end = 8 + n * cls.SLOTS * 2
        own.buckets = np.frombuffer(data[8:end], np.uint16).reshape(n, cls.SLOTS).copy()
        own.stash = {(int(a), int(b)): int(c) for a, b, c in np.frombuffer(data[end:], np.int64).reshape(-1, 3)}
        return own


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16 hashed bytes of a line's key; None if the key is too short."""
    import xxhash

    key = line.strip().lower()  # bytes: only A-Z, and white space is \x20 \x09-\x0D
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo): each long enough key of each row once. Rows without doc_id have no say and are left alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows, keys = [], []
            for i, t in enumerate(b.column(1)):
                own = {line_key(x, min_chars) for x in t.as_py().split(b"\n")} - {None}
                keys += own
                rows += [i] * len(own)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "hi", "lo"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.encode(text_of(), "UTF-8").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, hi long, lo long")


@dataclass
class LineIndex:
    changes: list[DataFrame]  # hi, lo, doc_id, sign
    versions: list[DataFrame]  # hi, lo, refs, keeper, version
    filters: dict[int, tuple[str, int]]  # shard -> file and the keys it has room for
    folder: str
    min_docs: int = MIN_DOCS
    shards: int = SHARDS

    @property
    def postings(self) -> DataFrame:
        """(hi, lo, doc_id) as the changes have left them."""
        if len(self.changes) == 1:
            return self.changes[0].drop("sign")
        found = reduce(DataFrame.unionByName, self.changes).groupBy("hi", "lo", "doc_id").agg(F.sum("sign").alias("sign"))
        return found.where("sign > 0").drop("sign")

    @property
    def refs(self) -> DataFrame:
        """(hi, lo, refs, keeper) of the keys that documents hold."""
        if len(self.versions) == 1:
            return self.versions[0].drop("version")
        found = reduce(DataFrame.unionByName, self.versions).groupBy("hi", "lo").agg(F.max_by(F.struct("refs", "keeper"), "version").alias("last"))
        return found.select("hi", "lo", "last.*").where("refs > 0")

    def with_(self, postings: DataFrame, sign: int, refs: DataFrame) -> LineIndex:
        """The index with further changes; both tables are written as one when there are BATCHES of them."""
        changes = [*self.changes, table(postings.select("hi", "lo", "doc_id", F.lit(sign).alias("sign")), "line-changes")]
        versions = [*self.versions, table(refs.select("hi", "lo", "refs", "keeper", F.lit(len(self.versions)).alias("version")), "line-versions")]
        out = LineIndex(changes, versions, dict(self.filters), self.folder, self.min_docs, self.shards)
        if len(changes) > BATCHES:
            out.changes = [table(out.postings.withColumn("sign", F.lit(1)), "line-changes")]
            out.versions = [table(out.refs.withColumn("version", F.lit(0)), "line-versions")]
        return out


def _shard(shards: int):
    return F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int")


def _count(posts: DataFrame) -> DataFrame:
    return posts.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.max("doc_id").alias("keeper"))


def _filters(changes: DataFrame, index: LineIndex, fresh: set[int] = frozenset()) -> dict[int, tuple[str, int]]:
    """Applies changes (hi, lo, up) to the filters and writes the new ones; those of ``fresh`` shards start empty."""
    uri, old = index.folder, {n: file for n, (file, _) in index.filters.items() if n not in fresh}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(uri)
        now, held = None, []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            hi, lo = (rows.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            up = rows.column("up").to_numpy(zero_copy_only=False)
            if now in old:
                with store.open_input_stream(f"{path}/{old[now]}", compression=None) as f:
                    own = CuckooFilter.from_bytes(f.read())
            else:
                own = CuckooFilter(int(up.sum()) * (2 if now in fresh else 1))
            own.delete(hi[~up], lo[~up])
            own.insert(hi[up], lo[up])
            name = new_name(f"filter-{now}", "bin")
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(own.to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([own.room], pa.int64())], ["shard", "file", "room"])

        for b in batches:
            shards = b.column(0).to_numpy()
            for at in [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1)] if len(shards) else []:
                if held and now != shards[at]:
                    yield close()
                    held = []
                now = int(shards[at])
                same = int(np.searchsorted(shards, now, "right"))
                held.append(b.slice(at, same - at))
        if held:
            yield close()

    rows = changes.select(_shard(index.shards).alias("shard"), "hi", "lo", "up").repartition("shard").sortWithinPartitions("shard")
    made = rows.mapInArrow(run, "shard int, file string, room long").collect()  # one row for each shard
    return index.filters | {r["shard"]: (r["file"], r["room"]) for r in made}


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> LineIndex:
    """The index of a whole table."""
    spark = docs.sparkSession
    posts = table(postings(docs, min_chars).select("hi", "lo", "doc_id").distinct().withColumn("sign", F.lit(1)), "line-postings")
    refs = table(_count(posts).withColumn("version", F.lit(0)), "line-refs")
    repeated = refs.where(F.col("refs") >= min_docs)
    index = LineIndex([posts], [refs], {}, scratch_path(spark, "line-filters"), min_docs, max(shards, repeated.count() // SHARD_KEYS))
    index.filters = _filters(repeated.withColumn("up", F.lit(True)), index)
    return index


def insert(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with further documents (documents that it holds already change nothing)."""
    new = postings(docs, min_chars).select("hi", "lo", "doc_id").distinct()
    new = table(new.join(index.postings, ["hi", "lo", "doc_id"], "left_anti"), "line-new")
    more = _count(new).select("hi", "lo", F.col("refs").alias("more"), F.col("keeper").alias("last"))
    refs = more.join(index.refs, ["hi", "lo"], "left").select("hi", "lo", (F.coalesce("refs", F.lit(0)) + F.col("more")).alias("refs"), F.greatest("keeper", "last").alias("keeper"))
    return _moved(index, index.with_(new, 1, refs), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_ids`` (doc_id): lines that they made repeated are given back."""
    gone = doc_ids.select("doc_id").distinct()
    old = table(index.postings.join(gone, "doc_id", "left_semi").select("hi", "lo", "doc_id"), "line-gone")
    touched = old.select("hi", "lo").distinct()
    left = index.postings.join(gone, "doc_id", "left_anti").join(touched, ["hi", "lo"], "left_semi")
    refs = touched.join(_count(left), ["hi", "lo"], "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return _moved(index, index.with_(old, -1, refs), old)


def _moved(before: LineIndex, after: LineIndex, changed: DataFrame) -> LineIndex:
    """``after`` with its filters: keys that have become repeated are put in, those that no longer are are taken out."""
    touched = changed.select("hi", "lo").distinct()
    repeated = lambda index, name: index.refs.join(touched, ["hi", "lo"], "left_semi").select("hi", "lo", (F.col("refs") >= index.min_docs).alias(name))
    both = touched.join(repeated(after, "up"), ["hi", "lo"], "left").join(repeated(before, "had"), ["hi", "lo"], "left").na.fill(False, ["up", "had"])
    moved = table(both.where("up <> had").select("hi", "lo", "up"), "line-moved")
    held = after.refs.where(F.col("refs") >= after.min_docs)
    sizes = held.groupBy(_shard(after.shards).alias("shard")).agg(F.count("*").alias("n")).collect()  # one row for each shard
    fresh = {r["shard"] for r in sizes if r["n"] > after.filters.get(r["shard"], ("", 0))[1]}
    own = _shard(after.shards).isin(list(fresh))
    rows = moved.where(~own).unionByName(held.where(own).select("hi", "lo", F.lit(True).alias("up"))) if fresh else moved
    after.filters = _filters(rows, after, fresh)
    return after


def known(index: LineIndex, posts: DataFrame) -> DataFrame:
    """The postings that the filters know: all repeated ones, and a few others by chance."""
    uri, files, shards = index.folder, {n: file for n, (file, _) in index.filters.items()}, index.shards
    kind = posts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(uri)
        now, own = None, None
        for b in batches:
            numbers = b.column(0).to_numpy()
            keep = np.zeros(len(numbers), bool)
            for at in [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1)] if len(numbers) else []:
                n = int(numbers[at])
                same = slice(at, int(np.searchsorted(numbers, n, "right")))
                if n != now:  # one shard's filter in memory at a time
                    now, own = n, None
                    if n in files:
                        with store.open_input_stream(f"{path}/{files[n]}", compression=None) as f:
                            own = CuckooFilter.from_bytes(f.read())
                if own is not None:
                    hi, lo = (b.column(c).to_numpy()[same].view(np.uint64) for c in (1, 2))
                    keep[same] = own.contains(hi, lo)
            yield b.select([1, 2, 3]).filter(pa.array(keep))

    rows = posts.select(_shard(shards).alias("shard"), "hi", "lo", "doc_id")
    rows = rows.repartition(F.col("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))).sortWithinPartitions("shard")
    return rows.mapInArrow(run, f"hi long, lo long, doc_id {kind}")


def dropped(index: LineIndex) -> DataFrame:
    """doc_id and the keys whose lines it loses: repeated ones, but for the largest doc_id that holds them."""
    exact = index.refs.where(F.col("refs") >= index.min_docs).select("hi", "lo", "keeper")
    lost = known(index, index.postings).join(exact, ["hi", "lo"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))  # at most a document's lines


def rewrite(docs: DataFrame, index: LineIndex, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row without its text as the struct ``doc``, with n_lines, n_dropped and the text that is kept.

    Null and empty texts are one empty line and stay as they are. Rows that repeat a doc_id are one document; of the documents
    that share a line the largest doc_id keeps it, in each of its rows. Very long texts are split whole, SLICE_ROWS texts at a
    time; an empty table gives no rows; columns may have any names. The text goes to Python and back once.
    """
    lost = dropped(index).withColumnRenamed("doc_id", "lost_id")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("doc"), F.col("doc_id").alias("own_id"), F.col("text").alias("t"))
    rows = rows.join(lost, F.col("own_id") == F.col("lost_id"), "left").select("doc", "t", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            total, gone, texts = [], [], []
            for t, keys in zip(b.column(1), b.column(2), strict=True):
                text = t.as_py()
                lines = (text or "").encode().split(b"\n")
                out = {np.array([k["hi"], k["lo"]], np.int64).tobytes() for k in keys.as_py() or ()}
                kept = [x for x in lines if line_key(x, min_chars) not in out] if out else lines
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode() if len(kept) < len(lines) else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc", "n_lines", "n_dropped", "kept"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, n_lines long, n_dropped long, kept string")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    slim = docs.select("doc_id", "text")
    out = rewrite(slim, build(slim))
    kept = F.encode(F.coalesce("kept", F.lit("")), "UTF-8")
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with the lines they keep; n_chars, where there is one, is that of the text that is left."""
    out = rewrite(docs, build(docs, **options))
    cols = []
    for f in docs.schema:
        if f.name == "text":
            c = F.col("kept")
        elif f.name == "n_chars":
            c = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("doc.n_chars")).cast(f.dataType)
        else:
            c = F.col(f"doc.`{f.name}`")
        cols.append(c.alias(f.name))
    return out.select(*cols)
