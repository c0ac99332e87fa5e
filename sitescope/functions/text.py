"""Text functions: tokens, normal forms, hashes, title suffixes, simhash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.filters import KeyFilter

TOKEN, NOT_TOKEN = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
#: Shingles whose bits are counted at a time (in 16 bits); those hashed at a time; bytes of texts that are read together.
SHINGLES, LANES, TOGETHER = 1 << 15, 1 << 13, 1 << 22
#: Letters of texts that are hashed together, words at a time; odd factors of letters in a word and of words in a run.
BLOCK, WORDS, LETTER_FACTOR, WORD_FACTOR = 1 << 20, 1 << 17, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
# What parts a title from the site's name.
SEPARATORS = (" | ", " - ", " – ", " — ", " :: ", " » ")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalised(text: Column) -> Column:
    """Trimmed, lower case, single spaces: equal for texts that read alike."""
    return F.lower(collapsed(text))


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(text), 256)


def present(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def first_h1(headings: Column) -> Column:
    return F.get(F.filter(headings, lambda h: h["level"] == 1), F.lit(0))["text"]


def old_years(text: Column, before: Column) -> Column:
    """Distinct years 1950 to 2099 in a text that are smaller than ``before``, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(19[5-9]\d|20\d\d)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y < before)))


def heading_jumps(headings: Column) -> Column:
    """``H2 → H4: text`` for each heading more than one level below the one before it; at most ten."""
    pairs = F.zip_with(F.slice(headings, 1, F.greatest(F.size(headings) - 1, F.lit(0))), F.slice(headings, 2, F.greatest(F.size(headings) - 1, F.lit(0))), lambda a, b: F.struct(a["level"].alias("p"), b["level"].alias("n"), b["text"].alias("t")))
    jumps = F.filter(pairs, lambda x: x["n"] > x["p"] + 1)
    shown = F.transform(jumps, lambda x: F.left(F.concat(F.lit("H"), x["p"].cast("string"), F.lit(" → H"), x["n"].cast("string"), F.lit(": "), F.coalesce(x["t"], F.lit(""))), F.lit(200)))
    return F.slice(F.when(F.size(headings) > 1, shown).otherwise(F.array().cast("array<string>")), 1, 10)


def title_suffix_candidates(title: Column) -> Column:
    """Separator and last segment of a title, for each separator that it holds."""
    last = [F.when(F.contains(title, F.lit(s)), F.concat(F.lit(s), F.substring_index(title, s, -1))) for s in SEPARATORS]
    return F.filter(F.array(*last), lambda x: x.isNotNull())


def common_title_suffix(pages: DataFrame, title: str = "title", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of ``keys``): the suffix that at least half of the titles (and two) share, or null. Ties: the smallest in code points."""
    titles = pages.where(F.col(title) != "").select(*keys, F.col(title).alias("t"))
    total = titles.groupBy(*keys).agg(F.count("*").alias("n"))
    hits = titles.select(*keys, F.explode(title_suffix_candidates(F.col("t"))).alias("suffix")).groupBy(*keys, "suffix").agg(F.count("*").alias("hits"))
    best = hits.groupBy(*keys).agg(F.min(F.struct((-F.col("hits")).alias("h"), "suffix")).alias("b"))
    enough = (F.col("n") >= 2) & (-F.col("b.h") >= F.greatest(F.lit(2.0), F.col("n") / 2.0))
    both = total.join(best, list(keys)) if keys else best.join(F.broadcast(total), F.lit(True))  # without keys: two tables of one row
    return both.select(*keys, F.when(enough, F.col("b.suffix")).alias("suffix"))


def strip_suffix(title: Column, suffix: Column) -> Column:
    own = F.trim(F.coalesce(title, F.lit("")))
    ends = F.coalesce(F.endswith(own, suffix) & (suffix != ""), F.lit(False))
    return F.when(ends, F.trim(F.left(own, F.length(own) - F.length(suffix)))).otherwise(own)


def shingles(words: Column, size: int = 3) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit simhash over 3-word shingles by BLAKE2b; null under 15 words. The bit pattern as a signed number."""
    import re

    import numpy as np

    word = re.compile(r"\w+")

    def one(text):
        words = [w.lower() for w in word.findall(text or "")]
        if len(words) < 15:
            return None
        data = b"".join(hashlib.blake2b(" ".join(words[i : i + 3]).encode(), digest_size=8).digest() for i in range(len(words) - 2))
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(bits * 2 > len(words) - 2).tobytes(), "big", signed=True)

    return pd.Series([one(t) for t in texts], dtype="Int64")


def md5_heads(data: bytes, starts, sizes):
    """First eight bytes of the MD5 of slices of ``data``: rows of uint8, from arrays of int64.

    RFC 1321 on columns of 32-bit words, one slice a row; slices that need a second block (over 55 bytes) go to hashlib.
    """
    import numpy as np

    u4 = np.dtype("<u4")
    padded = data + bytes(64)
    at = np.ndarray((len(data) + 60,), u4, padded, strides=(1,))  # the word that starts at each byte
    kept = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], u4)
    ended = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], u4)
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    sines = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(u4)
    heads = np.empty((len(starts), 2), u4)
    for low in range(0, len(starts), LANES):
        own, size = starts[low : low + LANES], np.minimum(sizes[low : low + LANES], 55)
        last = int(size.max()) // 4
        block = {14: (size * 8).astype(u4)}
        for j in range(last + 1):
            left = np.clip(size - 4 * j, -1, 4) + 1
            block[j] = (at[own + 4 * j] & kept[left]) | ended[left]
        first = [np.full(len(own), v, u4) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (v.copy() for v in first)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = block.get((i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16)
            turn = turns[i // 16][i % 4]
            np.add(f, a, out=f), np.add(f, sines[i], out=f)
            if word is not None:
                np.add(f, word, out=f)
            np.left_shift(f, turn, out=t), np.right_shift(f, 32 - turn, out=f), np.bitwise_or(f, t, out=f)
            a, b, c, d = d, np.add(f, b, out=a), b, c
        heads[low : low + LANES, 0], heads[low : low + LANES, 1] = a + first[0], b + first[1]
    heads = heads.view(np.uint8)
    for i in np.flatnonzero(sizes > 55):
        own = data[starts[i] : starts[i] + sizes[i]]
        heads[i] = np.frombuffer(hashlib.md5(own, usedforsecurity=False).digest()[:8], np.uint8)
    return heads


def md5_simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) with the first 60 bits of MD5 in place of BLAKE2b.

    Words are cut and lower-cased by Spark and stand one space apart, so that a shingle is a slice of the text; bits are
    counted where a document is read, for some megabytes of documents together, SHINGLES at a time, and nothing is shuffled.
    Documents under 15 words are left out; rows that repeat a key are documents of their own.
    """
    low = F.trim(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NOT_TOKEN, " ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def fingerprints(texts: list[bytes]):
            data = b" ".join(texts)
            ends = np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data)]
            starts = np.r_[0, ends[:-1] + 1]
            words = np.array([t.count(b" ") + 1 for t in texts])
            doc = np.repeat(np.arange(len(texts)), words)
            own = np.flatnonzero((doc[:-2] == doc[2:]) & (words[doc[:-2]] >= 15))
            ones = np.zeros((len(texts), 64), np.int64)
            for i in range(0, len(own), SHINGLES):
                part = own[i : i + SHINGLES]
                bits = np.unpackbits(md5_heads(data, starts[part], ends[part + 2] - starts[part]), axis=1)
                cuts = [0, *(np.flatnonzero(np.diff(doc[part])) + 1).tolist(), len(part)]
                for start, end in pairwise(cuts):
                    ones[doc[part[start]]] += bits[start:end].sum(axis=0, dtype=np.uint16)
            found = np.packbits(ones * 2 > (words - 2)[:, None], axis=1).view(">u8").ravel() >> 4
            return pa.array(found.astype(np.int64), mask=words < 15)

        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy()
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 512]), TOGETHER, "right")))
                rows = b.slice(at, n)
                found = fingerprints(rows.column(1).to_pylist())
                kept = found.is_valid()
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(kept), found.filter(kept)], [key, "simhash"])
                at += n

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.encode(low, "UTF-8").alias("t")).mapInArrow(run, f"`{key}` {kind}, simhash long")


def hashed_runs(rows: DataFrame, text: str, seed: str, sizes: list[int], among: KeyFilter | None = None, longest: bool = False) -> DataFrame:
    """(other columns of ``rows``, size, g): hashes of ``size`` neighbouring words of a text (in lower case) and of ``seed``, a
    long; each once for a row; only those that ``among`` may hold; where ``longest``, only of the largest size a row has.

    A word's hash is a difference of prefix sums over its letters, a run's a sum over its words, both modulo 2^64, so that all
    words of about BLOCK letters of texts are hashed in numpy columns together. Equal runs have equal hashes; as others may
    share one, what is found by a hash is to be compared.
    """
    others = [f for f in rows.schema if f.name not in (text, seed)]
    names, most = [f.name for f in others], max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        import numpy as np

        u8 = np.uint64
        inside = np.array([c == 95 or unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])
        tables = [np.ones(1, u8), np.ones(1, u8)]

        def mixed(z):
            for turn, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> u8(turn))) * u8(factor)
            return z ^ (z >> u8(31))

        def hashed(texts: list[str]):
            """The text and the hash of every word."""
            data = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
            own = np.r_[False, inside[data], False]
            edges = np.flatnonzero(own[1:] != own[:-1])
            starts, ends = edges[::2], edges[1::2]
            own = np.empty(len(starts), u8)
            for i in range(0, len(starts), WORDS):
                start, end = starts[i : i + WORDS], ends[i : i + WORDS]
                part = data[start[0] : end[-1]]
                if len(part) > len(tables[0]):
                    for k, factor in enumerate((LETTER_FACTOR, pow(LETTER_FACTOR, -1, 1 << 64))):
                        tables[k] = np.full(len(part) + WORDS, factor, u8)
                        tables[k][0] = 1
                        np.multiply.accumulate(tables[k], out=tables[k])
                total = np.zeros(len(part) + 1, u8)
                np.cumsum(part * tables[0][: len(part)], out=total[1:])
                own[i : i + WORDS] = mixed((total[end - start[0]] - total[start - start[0]]) * tables[1][start - start[0]])
            return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right"), own

        def found(texts: list[str], seeds):
            """(text, size, hash) as three columns."""
            of, own = hashed(texts)
            count = np.minimum(np.bincount(of, minlength=len(texts)), most)
            out, h = [(np.empty(0, np.int64),) * 2 + (np.empty(0, u8),)], own
            for k in range(2, most + 1):
                h = h[:-1] * u8(WORD_FACTOR) + own[k - 1 :]
                if k not in sizes or not len(h):
                    continue
                g = mixed(h + seeds[of[: len(h)]] + u8(k))
                at = np.arange(len(h)) if among is None else among.may_hold(g)
                at = at[of[at] == of[at + (k - 1)]]
                if longest:
                    at = at[count[of[at]] == k]
                at = at[np.lexsort((g[at], of[at]))]
                at = at[np.r_[True, (of[at][1:] != of[at][:-1]) | (g[at][1:] != g[at][:-1])][: len(at)]]
                out.append((of[at], np.full(len(at), k), g[at]))
            return [np.concatenate(c) for c in zip(*out, strict=True)]

        for b in batches:
            texts, seeds = b.column(text), b.column(seed).to_numpy().view(u8)
            letters = pc.utf8_length(texts).to_numpy()
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(letters[at : at + 4096]), BLOCK, "right")))
                of, size, g = found(texts.slice(at, n).to_pylist(), seeds[at : at + n])
                rest = [b.column(c).take(pa.array(of + at)) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(size.astype(np.int32)), pa.array(g.view(np.int64))], [*names, "size", "g"])
                at += n

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return rows.withColumn(text, F.coalesce(text, F.lit(""))).mapInArrow(run, f"{own}size int, g long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
