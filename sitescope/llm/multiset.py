"""Homomorphic multiset hashes of documents: sums of wide vectors hashed from paragraphs, modulo powers. DataFrame functions only.

A paragraph is what stands between two line feeds, as it is (a text without one is one paragraph, the empty text the empty
one). Its vector has LIMBS numbers of 60 bits:

* one that counts its pieces, modulo 2^60;
* two from an MD5 of the whole paragraph, modulo 2^60 each (120 bits);
* thirty-two that hold 128 counters of fifteen bits, four in a number. A piece is a word with the word before it in the
  paragraph; it adds one, modulo 2^15, to the counter that seven bits of its MD5 name.

The fingerprint of a text is the sum of the vectors of its paragraphs: it does not depend on their order, and paragraphs are
inserted by ``plus`` and deleted by ``minus`` without the rest of the text. Texts of the same paragraphs, each as often, have
equal fingerprints; others differ in the 120 bits (by chance equal with 2^-120). With their mean taken off, counters are those of
a count sketch: their products estimate how many pieces two texts share (twice the product over the sum of squares, cut to
0..1; standard error about 0.09). A piece that occurs some 16,000 times may wrap its counter: the estimate of such a text is
off, the equality is not.

Special cases: null texts are empty ones; very long texts are summed whole; equal texts and
repeated rows have equal fingerprints; an empty table gives an empty one; other columns may have any names. The order of
documents is by descending doc_id, nulls last, then by the MD5 of the text; rows equal in both are interchangeable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

HEADS, BINS, BITS, FIELDS = 3, 128, 15, 4
LIMBS = HEADS + BINS // FIELDS
_FIELDS = [BITS * k for k in range(FIELDS)]
_ONES = sum(1 << f for f in _FIELDS)
_ALL, _TOP = (1 << 60) - 1, 1 << 59
_TOPS = _ONES << (BITS - 1)
#: Documents in a range of ids, and ranges at most (256 times 256).
RANGE_ROWS, SPLIT = 256, 256
NO_ID = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _added(x: Column, y: Column, top: int) -> Column:
    """Sum of numbers of 60 bits whose fields, with the top bits ``top``, are added apart."""
    low = _long(_ALL ^ top)
    return (x.bitwiseAND(low) + y.bitwiseAND(low)).bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(_long(top)))


def _taken(x: Column, y: Column, top: int) -> Column:
    low, high = _long(_ALL ^ top), _long(top)
    return (x.bitwiseOR(high) - y.bitwiseAND(low)).bitwiseXOR(F.bitwise_not(x.bitwiseXOR(y)).bitwiseAND(high))


def _each(x: Column, y: Column, op: Callable[[Column, Column, int], Column]) -> Column:
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.transform(pairs, lambda p, i: F.when(i < HEADS, op(p["x"], p["y"], _TOP)).otherwise(op(p["x"], p["y"], _TOPS)))


def plus(x: Column, y: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _each(x, y, _added)


def minus(x: Column, y: Column) -> Column:
    """The fingerprint of the paragraphs of ``x`` without those of ``y``."""
    return _each(x, y, _taken)


def _halves(md5s: Column, at: int) -> Column:
    """Sixty bits of each hash, from the digit ``at`` on."""
    return F.transform(md5s, lambda h: F.conv(F.substring(h, at, 15), 16, 10).cast("long"))


def _pieces(paragraphs: Column) -> Column:
    words = F.transform(paragraphs, lambda p: F.array_remove(F.split(p, r"[\x20\x09-\x0D]+"), ""))
    with_last = lambda ws: F.transform(ws, lambda w, i: F.concat(F.coalesce(F.get(ws, i - 1), F.lit("")), F.lit(" "), w))
    return F.flatten(F.transform(words, with_last))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, _long(0), lambda a, x: _added(a, x, _TOP))


def _counted(hashes: Column) -> Column:
    """The counters of pieces, four in a number: each piece is one character, and characters are counted in the whole."""
    digits = F.transform(hashes, lambda h: F.concat(F.translate(F.substring(h, 1, 1), "89abcdef", "01234567"), F.substring(h, 2, 1)))
    marks = F.decode(F.unhex(F.array_join(digits, "")), "US-ASCII")
    count = lambda marks, b: F.octet_length(marks) - F.octet_length(F.replace(marks, F.char(b), F.lit("")))
    counts = let(marks, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: (count(m, b) % 2**BITS).cast("long")))
    packed = lambda c: F.transform(F.sequence(F.lit(1), F.lit(BINS), F.lit(FIELDS)), lambda at: sum((F.element_at(c, at + k) * (1 << f) for k, f in enumerate(_FIELDS)), _long(0)))
    return let(counts, packed)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null: an array of LIMBS longs."""

    def of(paragraphs: Column) -> Column:
        whole = F.transform(paragraphs, lambda p: F.md5(p))
        hashes = F.transform(_pieces(paragraphs), lambda p: F.md5(p))
        sums = lambda found: F.array(*[_total(_halves(found, at)) for at in (1, 16)])
        return let(hashes, lambda found: F.concat(F.array(F.size(found).cast("long")), let(whole, sums), _counted(found)))

    return let(F.split(text, "\n"), of)


def written(fp: Column) -> Column:
    """A fingerprint as a string: fifteen lowercase hexadecimal digits for each number."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _centred(fp: Column) -> Column:
    """BINS times each counter, less the number of pieces: of the numbers equal modulo BINS * 2^15 that nearest zero."""
    fields, top = F.array(*[F.lit(f) for f in _FIELDS]), BINS << BITS
    parts = F.flatten(F.transform(F.slice(fp, HEADS + 1, BINS // FIELDS), lambda x: F.transform(fields, lambda f: F.call_function("shiftright", x, f).bitwiseAND(_long(2**BITS - 1)))))
    return F.transform(parts, lambda c: F.pmod(c * BINS - F.element_at(fp, 1) % top + top // 2, _long(top)) - top // 2)


def likeness(x: Column, y: Column) -> Column:
    """The estimated part of pieces that two fingerprints share, 0 to 1; 1 for equal ones."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), _long(0), lambda s, v: s + v)
    part = lambda a, b: let(dot(a, a) + dot(b, b), lambda both: F.when(both > 0, 2 * dot(a, b) / both).otherwise(0.0))
    estimate = let(_centred(x), lambda a: let(_centred(y), lambda b: part(a, b)))
    return F.when(x == y, F.lit(1.0)).otherwise(F.least(F.greatest(estimate, F.lit(0.0)), F.lit(1.0)))


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """Adds columns behind a generator, so that the optimizer does not repeat their expressions where they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, text, fp): the struct of ``columns``, the text (null: empty) and its fingerprint."""
    return once(docs.select(F.struct(*columns).alias("doc"), text_of().alias("text")), fp=fingerprint(F.col("text")))


def edited(fp: Column, old: Column, new: Column, kept: Column) -> Column:
    """The fingerprint of a text after an edit, from the one before: ``old`` and ``new`` agree on their first ``kept`` code points.

    Only the paragraphs from that of the first change on are deleted and inserted.
    """
    stem = kept - F.length(F.substring_index(F.substr(old, F.lit(1), kept), "\n", -1)) + 1
    return let(stem, lambda at: plus(minus(fp, fingerprint(F.substr(old, at))), fingerprint(F.substr(new, at))))


def _ranges(rows: DataFrame) -> Column:
    """The range of a row (id, u): ranges of ids of about RANGE_ROWS rows, in rising order. A frequent id has several, by u.

    The driver gets SPLIT * SPLIT boundaries at most; they are looked up in two steps.
    """
    n = min(SPLIT * SPLIT, rows.count() // RANGE_ROWS + 1)
    found = []
    if n > 1:
        found = rows.select(F.approx_percentile("id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0]
    cuts = F.lit(found).cast("array<bigint>") if found else F.array().cast("array<bigint>")
    heads = F.lit(found[SPLIT - 1 :: SPLIT]).cast("array<bigint>") if found[SPLIT - 1 :: SPLIT] else F.array().cast("array<bigint>")

    def below(less: Callable[[Column], Column]) -> Column:
        """How many boundaries ``less`` holds for: whole parts of SPLIT, then those of the next part."""
        parts = F.size(F.filter(heads, less))
        return let(parts, lambda p: p * SPLIT + F.size(F.filter(F.slice(cuts, p * SPLIT + 1, SPLIT), less)))

    low, high = below(lambda c: c < F.col("id")), below(lambda c: c <= F.col("id"))
    return low + F.floor((high - low + 1) * F.col("u")).cast("int")


def _keys(docs: DataFrame) -> DataFrame:
    """Adds id (nulls below all others), key and u, a number in [0, 1) that falls with the key."""
    key = F.md5(text_of())
    id = F.when(F.col("doc_id").isNull(), _long(NO_ID)).otherwise(F.greatest(F.col("doc_id").cast("long"), _long(NO_ID + 1)))
    u = (F.lit((1 << 52) - 1) - F.conv(F.substring(key, 1, 13), 16, 10).cast("long")) / F.lit(float(1 << 52))
    return docs.select("doc_id", "text", id.alias("id"), key.alias("key"), u.alias("u"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): every document with its fingerprint, and those of the next one.

    Texts are dealt once, to ranges of ids; the first document of every range goes to the range before as well. What is known
    of all ranges is their first key.
    """
    keys = _keys(docs.select("doc_id", "text"))
    place = _ranges(keys)
    order = F.struct((-1 - F.col("id")).alias("down"), "key")
    firsts = keys.groupBy(place.alias("range")).agg(F.min(order).alias("first"))
    firsts = sorted(firsts.collect(), key=lambda r: -r["range"])  # one row for each range, bounded as they are
    made = [(r["range"], r["first"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    side = docs.sparkSession.createDataFrame(made, "range int, first struct<down: long, key: string>, before int")
    rows = keys.select("doc_id", text_of().alias("text"), order.alias("order"), place.alias("range"))
    rows = once(rows, fp=fingerprint(F.col("text"))).join(F.broadcast(side), "range")
    where = F.when(F.col("order") == F.col("first"), F.array("range", "before")).otherwise(F.array("range"))
    rows = rows.select("doc_id", "text", "fp", "order", F.posexplode(where).alias("copy", "range"))
    by = Window.partitionBy("range").orderBy("copy", "order")
    after = F.lead(F.struct("text", "fp")).over(by)
    return rows.withColumn("after", after).where("copy = 0").select("doc_id", "text", "fp", F.col("after.text").alias("next_text"), F.col("after.fp").alias("next_fp"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and its likeness to the next document and to itself with the second half replaced."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("*", n.alias("n"), (n - half).alias("kept"), half.alias("half"))
    rows = once(rows, new=F.concat(F.substr("text", F.lit(1), F.col("kept")), F.substr("next_text", F.lit(1), F.col("half"))))
    rows = once(rows, new_fp=edited(F.col("fp"), F.col("text"), F.col("new"), F.col("kept")))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("new", 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("new_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("new_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
