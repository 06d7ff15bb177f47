"""Substring dedup by sliding spans of sentences.

A text is cut into sentence units: after a stop, exclamation or question mark or comma with white space
behind it, and at line ends.  Commas count because passages are often set into the middle of a sentence;
units resume in step soon after such a seam.  From each unit on, the shortest run of at least ``RUN``
units and ``WORDS`` words is a span, and so is the shortest such run that ends with the text.

Not every passage holds such a run, whatever its length.  So of each ``WINDOW`` consecutive runs of ``LONG``
words the one with the smallest hash is a span too, wherever its sentences end, unless a span of units lies
inside it, which then does its work.  A shared passage of ``LONG + WINDOW - 1`` words or more, hence any of
over 50, holds a whole span.  In scripts without spaces a character counts as a word.

Spans are hashed to 96 bits and joined globally; of equal spans the one with the smallest (doc_id, offset) is
first, a null doc_id after all others, and every unit that another one covers is removed.

A task passes on one occurrence of each span it sees, its first, and marks its others as repeats at
once, so a span that stands in a third of all documents costs a few entries per task.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rewrite import keyed, rewrite
from .scratch import map_batches, stored, table

RUN, WORDS = 3, 30
LONG, WINDOW = 30, 12
_SEAM = re.compile(r"[.!?,]['\")\]]*\s+|\s*\n\s*")
#: Thai, Lao, Burmese, Khmer, kana and Han, of which each character is a word.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_BLANK, _ALONE = 1, 2
#: What each code point is: part of a word, white space, or a word by itself.
_KIND = np.zeros(0x110000, np.uint8)
_KIND[[c for c in range(0x3001) if chr(c).isspace()]] = _BLANK
for _first, _last in _UNSPACED:
    _KIND[_first : _last + 1] = _ALONE
_MIX, _OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Spans and texts that a task holds before it passes them on.
FLUSH, TEXTS = 1 << 19, 1 << 14
#: A span: two hashes, its text's id and half of its hash, its start and its length, LONGER standing for more; NULL marks a text without an id.
_SPAN = np.dtype([("h", "<u8"), ("x", "<u4"), ("id", "<i8"), ("t", "<u4"), ("a", "<u4"), ("n", "<u2")])
LONGER, NULL = 0x7FFF, 0x8000
#: How a span knows its text among those of its id.
_TEXT = 0xFFFFFFFF


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def units(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text's code points: what spans are made of."""
    kind = _KIND[points]
    word, alone = kind != _BLANK, kind == _ALONE
    joins = word & ~alone
    before, after = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
    before[1:], after[:-1] = joins[:-1], joins[1:]
    return np.flatnonzero(word & (alone | ~before)), np.flatnonzero(word & (alone | ~after)) + 1


def sentences(text: str) -> tuple[list[int], list[int]]:
    """Start and end of each sentence unit; what lies between two units is white space, or nothing."""
    starts, ends, at = [], [], 0
    for m in _SEAM.finditer(text):
        if m.start() > at or text[at : m.end()].strip():
            starts.append(at)
            ends.append(m.end())
        at = m.end()
    if at < len(text) and text[at:].strip():
        starts.append(at)
        ends.append(len(text))
    return starts, ends


def spans(text: str | None, run: int = RUN, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, other hash, start, end) of each span of a text; none for null, blank or shorter texts."""
    text = text or ""
    points = _points(text)
    at, to = units(points)
    m = len(at)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = _rolling((points + np.uint64(1)) * np.uint64(_OTHER), _MIX)(at, to)
    hashed, other = _rolling(hashes, _MIX), _rolling(hashes ^ (hashes >> np.uint64(29)), _OTHER)
    starts, ends = sentences(text)
    n = len(starts)
    # Words before each unit and before the end; a unit of stops alone between spaces is a word as well.
    counts = np.append(np.searchsorted(at, starts), m)
    i = j = np.zeros(0, np.int64)
    if n >= run:
        last = np.maximum(np.searchsorted(counts, counts[:-1] + words), np.arange(n) + run)  # the span is units i .. last - 1
        fits = last <= n
        i, j = np.flatnonzero(fits), last[fits]
        if len(i) and j[-1] < n:  # the end of the text is in a span too: in the shortest that reaches it
            i, j = np.append(i, i[-1]), np.append(j, n)
    first, last = counts[i], counts[j]
    a, b = np.array(starts, np.int64)[i], np.array(ends, np.int64)[j - 1]
    if m >= LONG:
        begin = np.arange(m - LONG + 1)
        grams = hashed(begin, begin + LONG)
        if len(grams) > WINDOW:
            view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
            begin = np.unique(np.arange(len(view)) + view.argmin(1))
        else:
            begin = np.array([grams.argmin()])
        if len(i):
            # The first span of units that starts behind a word of the run, so that its seam is in the run, and the least end from there on.
            least = np.minimum.accumulate(last[::-1])[::-1]
            inner = np.searchsorted(first, begin, side="right")
            begin = begin[np.append(least, m + 1)[inner] >= begin + LONG]
        first, last = np.concatenate([first, begin]), np.concatenate([last, begin + LONG])
        a, b = np.concatenate([a, at[begin]]), np.concatenate([b, to[begin + LONG - 1]])
        order = np.lexsort((a, last, first))
        first, last, a, b = first[order], last[order], a[order], b[order]
        once = np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])  # a run that is a span of both kinds
        first, last, a, b = first[once], last[once], a[once], b[once]
    return hashed(first, last), (other(first, last) >> np.uint64(32)).astype(np.uint32), a, b


#: Words or characters up to which the powers of a multiplier are kept in a worker.
KEPT = 1 << 14


@lru_cache(4)
def _powers(mix: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64, up to ``size``."""
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, mix, np.uint64)]))
        return up, np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, pow(mix, -1, 1 << 64), np.uint64)]))


def _rolling(hashes: np.ndarray, mix: int):
    """A function that hashes words i .. j - 1: sums of hash * power, divided by the first power, are the same wherever a run stands."""
    m = len(hashes)
    powers, back = _powers(mix, KEPT) if m <= KEPT else _powers.__wrapped__(mix, m)  # of longer texts nothing is kept
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * powers[:m])])

    def hashed(i, j):
        with np.errstate(over="ignore"):
            h = (sums[j] - sums[i]) * back[i] + (j - i).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(29))

    return hashed


def _packed(found: np.ndarray, ends: np.ndarray) -> bytes:
    """Spans by byte planes, field after field: what ids, starts and lengths have in common, mostly zeros, lies together and is compressed on disk and on the wire."""
    length = ends - found["a"].astype(np.int64)
    found = found.copy()
    found["n"] |= np.minimum(length, LONGER).astype(np.uint16)
    planes = [np.ascontiguousarray(found[f]).view(np.uint8).reshape(len(found), -1).T.tobytes() for f in _SPAN.names]
    return np.array([len(found)], "<i8").tobytes() + b"".join(planes) + length[length >= LONGER].astype("<i8").tobytes()


def _unpacked(blob: bytes, hashes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(spans, the end of each); with ``hashes`` the first hash of each alone."""
    n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
    found = np.zeros(n, _SPAN)
    for f in _SPAN.names:
        size = _SPAN[f].itemsize
        found[f] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(_SPAN[f]).reshape(n)
        at += n * size
        if hashes:
            return found["h"], found["h"]
    length = (found["n"] & LONGER).astype(np.int64)
    length[length == LONGER] = np.frombuffer(blob, "<i8", offset=at)
    return found, found["a"].astype(np.int64) + length


def _ordered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal spans together, the first one first; which spans in it are the first of their kind, and which stand again in a row that is repeated whole."""
    null = found["n"] & NULL
    order = np.lexsort((found["t"], found["a"], found["id"], null, found["x"], found["h"]))
    f = found[order]
    if not len(f):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    alike = lambda *names: np.logical_and.reduce([f[c][1:] == f[c][:-1] for c in names])
    same = alike("h", "x")
    again = same & alike("id", "t", "a") & (null[order][1:] == null[order][:-1])
    return order, np.concatenate([[True], ~same]), np.concatenate([[False], again])


def occurrences(docs: DataFrame, buckets: int, run: int, words: int) -> DataFrame:
    """(bucket, blob) of each task's first occurrences, and (null, blob) of its repeats. A blob leaves as soon as it is packed, and what it was packed from is held once."""

    def flush(held, keys):
        size = [len(x[0]) for x in held]
        found = np.zeros(sum(size), _SPAN)
        for name, i in (("h", 0), ("x", 1), ("a", 2)):
            found[name] = np.concatenate([x[i] for x in held])
        for name, i in (("id", 0), ("t", 1), ("n", 2)):
            found[name] = np.repeat(np.array([k[i] for k in keys], _SPAN[name]), size)
        ends = np.concatenate([x[3] for x in held])
        held.clear()
        keys.clear()
        order, new, again = _ordered(found)
        found, ends = found[order], ends[order]
        if (repeat := ~new & ~again).any():
            yield None, _packed(found[repeat], ends[repeat])
        found, ends = found[new], ends[new]
        bucket = (found["h"] & np.uint64(buckets - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for x in np.unique(bucket).tolist():
            rows = order[cuts[x] : cuts[x + 1]]
            yield x, _packed(found[rows], ends[rows])

    def task(batches):
        held, keys, size = [], [], 0
        for batch in batches:
            for doc_id, t, text in zip(batch["doc_id"], batch["t"], batch["text"], strict=True):
                found = spans(text, run, words)
                if len(found[0]):
                    held.append(found)
                    keys.append((doc_id or 0, t & _TEXT, NULL * (doc_id is None)))
                    size += len(found[0])
                if size >= FLUSH or len(held) == TEXTS:
                    for x, blob in flush(held, keys):
                        yield {"bucket": [x], "blob": [blob]}
                    size = 0
        if held:
            for x, blob in flush(held, keys):
                yield {"bucket": [x], "blob": [blob]}

    return map_batches(keyed(docs).select("doc_id", "t", "text").where(F.length("text") > 0), task, "bucket int, blob binary")


def _rows(found, ends):
    for at in range(0, len(found), 65536):
        f = found[at : at + 65536]
        yield {"id": f["id"], "missing": f["n"] >= NULL, "t": f["t"].astype(np.int64), "start": f["a"].astype(np.int64), "end": ends[at : at + 65536]}


def repeats(docs: DataFrame, run: int = RUN, words: int = WORDS, spans_per_bucket: int = 400_000) -> DataFrame:
    """(doc_id, t, start, end): each span that isn't the first of its kind; ``t`` is half of the text's hash, which tells apart the texts of one id."""
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, size / 30 / spans_per_bucket)))))
    seen = stored(occurrences(docs, buckets, run, words), "spans")

    def local(batches):
        for batch in batches:
            for blob in batch["blob"]:
                yield from _rows(*_by_parts(*_unpacked(blob)))

    def folded(blobs: list[bytes]):
        """Repeats among one bucket's spans; only those whose hash stands twice are held with their keys."""
        hashes = [_unpacked(blob, True)[0] for blob in blobs]
        h = np.sort(np.concatenate(hashes))
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        parts = []
        for blob, h in zip(blobs, hashes, strict=True):
            keep = np.isin(h, twice)
            parts.append([x[keep] for x in _unpacked(blob)])
        found, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new, again = _ordered(found)
        order = order[~new & ~again]
        yield from _rows(*_by_parts(found[order], ends[order]))

    def across(batches):
        """A partition's buckets come one behind the other, and one at a time is held."""
        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch["bucket"], batch["blob"], strict=True):
                if bucket != at and blobs:
                    yield from folded(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield from folded(blobs)

    schema = "id long, missing boolean, t long, start long, end long"
    inside = map_batches(seen.where("bucket IS NULL").select("blob"), local, schema, rows=16)
    both = inside.union(map_batches(seen.where("bucket IS NOT NULL").repartition(buckets, "bucket").sortWithinPartitions("bucket"), across, schema, rows=16))
    return both.select(F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "t", "start", "end")


def _by_parts(found, ends):
    """Spans in the order of their texts, those of a text that touch joined to one: fewer rows cross the cluster."""
    if not len(found):
        return found, ends
    null = found["n"] & NULL
    order = np.lexsort((found["a"], found["t"], found["id"], null))
    found, ends, null = found[order], ends[order], null[order]
    other = (found["id"][1:] != found["id"][:-1]) | (found["t"][1:] != found["t"][:-1]) | (null[1:] != null[:-1])
    text = np.concatenate([[0], np.cumsum(other)])
    # The furthest end so far within a text: ends are moved apart by more than any text is long.
    far = np.maximum.accumulate(ends + text * (np.int64(1) << 40)) - text * (np.int64(1) << 40)
    starts = np.flatnonzero(np.concatenate([[True], other | (found["a"][1:] > far[:-1])]))
    return found[starts], np.maximum.reduceat(ends, starts)


def removed(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, t, start, end): the stretches to remove, repeated spans of a row joined where they touch."""
    order = Window.partitionBy("doc_id", "t").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats(docs, run, words).withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with repeated sentences taken out of ``text`` and ``n_chars`` set anew; all other columns and rows stay, whatever their names.

    Null and empty texts stay as they are; a text whose sentences are all repeats becomes empty.  Rows
    with the same doc_id and text count as one occurrence and are treated alike.  An empty table stays empty.
    """
    return rewrite(docs, removed(docs, run, words).withColumn("put", F.lit("")), {"t": F.xxhash64("text").bitwiseAND(F.lit(_TEXT))})


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stretch of ``documents`` that is removed: doc_id, start and end in characters; see ``dedup`` for nulls, repeats and empty tables."""
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "start", "end")
