"""Scores of texts under an interpolated modified Kneser-Ney model of n-grams.

Tokens are the words between ASCII white space, A-Z in lower case, and one end for each text; a start stands before
the first.  Spark counts n-grams: a task counts slices of whole texts and sends each shard of the hash space its part,
packed; a shard's task adds them up, writes them as a table and sends on what the next lower order needs, which is
how many different words stand before each shorter n-gram, and each context's total and numbers of followers seen
once, twice and more.  N-grams that begin with the start keep their plain counts.

A table is a file of sorted hash arrays in the shared folder.  Workers map the files into memory and look up the
distinct n-grams of a slice in the order of their hashes, so each page is met once for a slice.  A shard belongs to a
range of hashes, never to a word, so a frequent word or context makes no large shard.  A word counts as 40 bits of its
hash inside n-grams and as 64 bits where its plain count is asked for.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_dir, stored, table

#: Words of the longest n-gram, bytes of text that are counted or scored at once, and characters of the corpus for each shard.
ORDER, SLICE, SHARE = 2, 8 << 20, 12_000_000
#: Discounts of an order whose counts of counts have a gap.
PLAIN = (0.5, 1.0, 1.5)
#: The plain counts of words are kept beside the orders, as order 0.
WORDS = 0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
_END, _START = (xxhash.xxh3_64_intdigest(s) for s in (" end", " start"))  # no word holds a space
_ROWS = "level int, kind string, shard int, blob binary, stats array<long>"
_SCHEMA = pa.schema([("level", pa.int32()), ("kind", pa.string()), ("shard", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 7; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _roll(h: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """The running hash of words, one further."""
    return (word & _LOW) + np.uint64(1) if h is None else h * _MIX + (word & _LOW) + np.uint64(1)


def _key(words: list[np.ndarray]) -> np.ndarray:
    h = None
    for w in words:
        h = _roll(h, w)
    return _finish(h)


class _Slice:
    """The tokens of whole texts as codes, a start before each text and an end behind."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        names, codes, offsets = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if "" in names:
            keep = codes != names.index("")
            offsets, codes = np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names] + [_END, _START], np.uint64)
        self.size = np.diff(offsets)
        self.starts = np.cumsum(self.size + 2) - self.size - 2
        n = len(names)
        self.codes = np.full(int((self.size + 2).sum()), -1, np.int64)
        self.codes[self.starts], self.codes[self.starts + self.size + 1] = n + 1, n
        self.codes[self.codes < 0] = codes
        self.age = np.arange(len(self.codes)) - np.repeat(self.starts, self.size + 2)

    def orders(self, most: int, counts_only: bool = False) -> Iterator[tuple]:
        """For each order: places of the last words of its n-grams, which n-gram ends there, and the n-grams' words (as codes of the order before and of words).

        Of the longest order counts stand in place of which n-gram it is, where only they are wanted.
        """
        n = len(self.hashes)
        at, inverse = np.arange(len(self.codes)), self.codes
        yield at, inverse, None, np.arange(n)
        which = inverse
        for k in range(2, most + 1):
            at = np.flatnonzero(self.age >= k - 1)
            key = which[at - 1] * n + self.codes[at]
            if counts_only and k == most:
                unique, counts = np.unique(key, return_counts=True)
                yield at, counts, unique // n, unique % n
                return
            unique, inverse = np.unique(key, return_inverse=True)
            yield at, inverse, unique // n, unique % n
            which = np.full(len(self.codes), -1, np.int64)
            which[at] = inverse


def _slices(text: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one row."""
    total = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)))
        yield at, to
        at = to


def _narrow(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = data.reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _dealt(level: int, kind: str, keys: np.ndarray, bits: int, pack) -> Iterator[dict]:
    """A packed row for each shard that has some of the keys."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange((1 << bits) + 1)) if bits <= 16 else None
    groups = enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if bits <= 16 else _runs(shard[order])
    for s, (a, b) in groups:
        if b > a:
            yield {"level": level, "kind": kind, "shard": s, "blob": pack(order[a:b]), "stats": None}


def _runs(values: np.ndarray):
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return zip(values[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(values)], strict=True), strict=True)


def _grams(level: int, words: list[np.ndarray], counts: np.ndarray, bits: int) -> Iterator[dict]:
    return _dealt(level, "grams", _key(words), bits, lambda i: b"".join([_narrow(w[i]) for w in words] + [counts[i].astype("<u4").tobytes()]))


def _batched(rows: Iterator[dict], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["blob"] or b"")
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)


def _counting(order: int, bits: int):
    """Counts of slices: n-grams of the longest order, shorter ones that begin with the start, and words."""

    def rows(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(text, SLICE):
                part = _Slice(text.slice(a, b - a))
                n = np.bincount(part.codes, minlength=len(part.hashes))[:-1]
                seen = np.flatnonzero(n)
                yield from _dealt(WORDS, "words", part.hashes[seen], bits, lambda i: part.hashes[seen][i].astype("<u8").tobytes() + n[seen][i].astype("<u4").tobytes())  # noqa: B023
                words: list[np.ndarray] = []
                for k, (at, which, before, last) in enumerate(part.orders(order, True), 1):
                    words = [w[before] for w in words] + [part.hashes[last]] if before is not None else [part.hashes]
                    if k == order:
                        if k == 1:
                            yield from _grams(1, [part.hashes[seen]], n[seen], bits)
                        else:
                            yield from _grams(k, words, which, bits)
                    elif k > 1:
                        unique, counts = np.unique(which[part.age[at] == k - 1], return_counts=True)
                        yield from _grams(k, [w[unique] for w in words], counts, bits)

    return lambda batches: _batched(rows(batches))


def _summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, where each stands, and each column summed by key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], [np.add.reduceat(c[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c in columns]


def _write(path: str, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, stats: list[np.ndarray]) -> None:
    """Sorted hash arrays: keys, counts of one byte (255: look among the large ones), the large ones, contexts and their sums. A file appears whole or not at all."""
    large = np.flatnonzero(counts >= 255)
    head = np.array([len(keys), len(large), len(contexts)], "<i8")
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        for data in (head, keys.astype("<u8"), keys[large].astype("<u8"), counts[large].astype("<i8"), contexts.astype("<u8"), stats[0].astype("<i8"), *[s.astype("<u4") for s in stats[1:]], np.minimum(counts, 255).astype(np.uint8)):
            file.write(data.tobytes())
    os.replace(part, path)


def _merging(order: int, bits: int, folder: str, level: int):
    """Adds up the shards of an order (and, in the first round, of words), writes their tables and sends on what the order below needs."""

    def shard(k: int, s: int, held: list[dict]):
        path = f"{folder}/{k}-{s}.bin"
        none = [np.zeros(0, np.int64)] * 4
        if k == WORDS:
            raw = [np.frombuffer(r["blob"], np.uint8) for r in held]
            n = [len(r) // 12 for r in raw]
            keys, _, (counts,) = _summed(np.concatenate([r[: 8 * m].view("<u8") for r, m in zip(raw, n, strict=True)]).astype(np.uint64), [np.concatenate([r[8 * m :].view("<u4") for r, m in zip(raw, n, strict=True)])])
            _write(path, keys, counts, np.zeros(0, np.uint64), none)
            yield {"level": WORDS, "kind": "stats", "shard": s, "blob": None, "stats": [len(keys), int(counts.sum())]}
            return
        grams = [np.frombuffer(r["blob"], np.uint8) for r in held if r["kind"] == "grams"]
        n = [len(r) // (5 * k + 4) for r in grams]
        words = [_wide(np.concatenate([r[5 * m * i : 5 * m * (i + 1)] for r, m in zip(grams, n, strict=True)] or [np.zeros(0, np.uint8)])) for i in range(k)]
        counts = np.concatenate([r[5 * k * m :].view("<u4") for r, m in zip(grams, n, strict=True)] or [np.zeros(0, "<u4")])
        del grams
        keys, at, (counts,) = _summed(_key(words), [counts])
        words = [w[at] for w in words]
        sums = [np.frombuffer(r["blob"], np.uint8) for r in held if r["kind"] == "contexts"]
        m = [len(r) // 24 for r in sums]
        column = lambda i: np.concatenate([r[8 * x + 4 * i * x : 8 * x + 4 * (i + 1) * x].view("<u4") for r, x in zip(sums, m, strict=True)] or [np.zeros(0, "<u4")])
        contexts, _, stats = _summed(np.concatenate([r[: 8 * x].view("<u8") for r, x in zip(sums, m, strict=True)] or [np.zeros(0, "<u8")]).astype(np.uint64), [column(i) for i in range(4)])
        _write(path, keys, counts, contexts, stats)
        yield {"level": k, "kind": "stats", "shard": s, "blob": None, "stats": [*[int((counts == c).sum()) for c in (1, 2, 3, 4)], int(counts.sum()), len(counts)]}
        if k == 1:
            return
        own = [counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64)]
        contexts, _, stats = _summed(_key(words[:-1]), own)
        # A context's total of a shard may pass 32 bits: then it goes in several rows.
        rest = stats
        while len(contexts):
            now = [np.minimum(c, 0xFFFFFFFF) for c in rest]
            yield from _dealt(k - 1, "contexts", contexts, bits, lambda i: contexts[i].astype("<u8").tobytes() + b"".join(c[i].astype("<u4").tobytes() for c in now))  # noqa: B023
            more = rest[0] > now[0]
            contexts, rest = contexts[more], [(c - d)[more] for c, d in zip(rest, now, strict=True)]
        keys, at, (different,) = _summed(_key(words[1:]), [np.ones(len(counts), np.int64)])
        yield from _grams(k - 1, [w[at] for w in words[1:]], different, bits)

    def rows(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["level"] not in (level, WORDS):
                    yield row
                    continue
                if (row["level"], row["shard"]) != key:
                    if held:
                        yield from shard(*key, held)
                    key, held = (row["level"], row["shard"]), []
                held.append(row)
        if held:
            yield from shard(*key, held)

    return lambda batches: _batched(rows(batches))


@dataclass(frozen=True)
class Model:
    """Where the tables are and the few numbers that hold for the whole corpus."""

    folder: str
    order: int
    bits: int
    tokens: int
    words: int
    #: By order: discounts of counts 1, 2 and more.
    discounts: tuple = field(default=())
    #: Different contexts of all words, and how many words have one, two and more.
    total: int = 0
    seen: tuple = (0, 0, 0)


def discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; ``PLAIN`` where one of them is 0."""
    if not (once and twice and thrice and four):
        return PLAIN
    y = once / (once + 2 * twice)
    return tuple(min(float(i), max(0.0, i - (i + 1) * y * b / a)) for i, a, b in ((1, once, twice), (2, twice, thrice), (3, thrice, four)))


def _mounted(spark: SparkSession) -> str:
    """The shared folder as a path that workers can map into memory."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("the model's tables are mapped into memory: spark.checkpoint.dir must be a folder that is mounted on every worker")
    return where.path


def fit(docs: DataFrame, order: int = ORDER, share: int = SHARE) -> Model:
    """Counts ``docs(text)``; null texts count as empty. The driver gets sums of six numbers for each order.

    ``share`` is how many characters of the corpus fall to a shard; it bounds what a task holds.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, size / share)))))
    folder = f"{_mounted(spark)}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counting(order, bits), _ROWS)
    stats: dict[int, list[int]] = {}
    for level in range(order, 0, -1):
        dealt = rows.repartition(1 << bits, "level", "shard").sortWithinPartitions("level", "shard", "kind")
        rows = stored(dealt.mapInArrow(_merging(order, bits, folder, level), _ROWS), "ngrams")
        found = rows.where("kind = 'stats'").select("level", F.posexplode("stats").alias("i", "n")).groupBy("level", "i").agg(F.sum("n").alias("n")).collect()
        for r in sorted(found):
            stats.setdefault(r["level"], [0] * 6)[r["i"]] = r["n"]
        rows = rows.where("kind <> 'stats'")
    words, tokens = stats.get(WORDS, [0, 0])[:2]
    first = stats.get(1, [0] * 6)
    return Model(folder, order, bits, tokens, words, tuple(discounts(*stats.get(k, [0] * 6)[:4]) for k in range(1, order + 1)), first[4], (first[0], first[1], first[5] - first[0] - first[1]))


@lru_cache(512)
def _mapped(path: str) -> tuple[np.ndarray, ...]:
    """A file's arrays, mapped into memory; empty ones where a shard has no file."""
    if not os.path.exists(path):
        empty = np.zeros(0, np.uint64)
        return empty, np.zeros(0, np.uint8), empty, empty, empty, [np.zeros(0, np.int64)] * 4
    data = np.memmap(path, np.uint8, "r")
    n, large, contexts = data[:24].view("<i8").tolist()
    at, out = 24, []
    for size, kind in ((n, "<u8"), (large, "<u8"), (large, "<i8"), (contexts, "<u8"), (contexts, "<i8"), *[(contexts, "<u4")] * 3, (n, "u1")):
        end = at + size * np.dtype(kind).itemsize
        out.append(data[at:end].view(kind))
        at = end
    return out[0], out[8], out[1], out[2], out[3], out[4:8]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` stand in sorted ``keys``, and where."""
    at = np.searchsorted(keys, wanted)
    hit = np.flatnonzero(at < len(keys))
    hit = hit[keys[at[hit]] == wanted[hit]]
    return hit, at[hit]


def _looked_up(model: Model, level: int, keys: np.ndarray, contexts: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of n-grams and, if wanted, their sums as contexts; 0 where there are none. Keys are met in their order."""
    counts, sums = np.zeros(len(keys), np.int64), [np.zeros(len(keys), np.int64) for _ in range(4 * contexts)]
    order = np.argsort(keys)
    ordered = keys[order]
    shard = (ordered >> np.uint64(64 - model.bits)).astype(np.int64)
    for s, (a, b) in _runs(shard) if len(keys) else ():
        own, codes, large, many, ctx, stats = _mapped(f"{model.folder}/{level}-{s}.bin")
        hit, at = _found(own, ordered[a:b])
        n = codes[at].astype(np.int64)
        if (over := np.flatnonzero(n == 255)).size:
            n[over] = many[np.searchsorted(large, ordered[a:b][hit[over]])]
        counts[order[a + hit]] = n
        if contexts:
            hit, at = _found(ctx, ordered[a:b])
            for out, values in zip(sums, stats, strict=True):
                out[order[a + hit]] = values[at]
    return counts, sums


def _less(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    """Counts without their discounts."""
    return np.maximum(counts - np.array((0.0, *by))[np.minimum(counts, 3)], 0.0)


def _scored(model: Model, part: _Slice) -> tuple[np.ndarray, ...]:
    """(tokens, tokens that the corpus has, base score, score) of each text."""
    plain, _ = _looked_up(model, WORDS, part.hashes, False)
    h = p = sums = None
    for k, (at, which, before, last) in enumerate(part.orders(model.order), 1):
        h = _roll(None if before is None else h[before], part.hashes[last])
        counts, new = _looked_up(model, k, _finish(h), k < model.order)
        less, by = _less(counts, model.discounts[k - 1]), model.discounts[k - 1]
        if k == 1:
            rest = sum(n * d for n, d in zip(model.seen, by, strict=True))
            p = ((less + rest / (model.words + 1)) / model.total if model.total else np.full(len(counts), 1 / (model.words + 1)))[part.codes]
        else:
            total, *follow = (s[at - 1] for s in sums)
            known = np.flatnonzero(total)
            where = at[known]
            p[where] = (less[which[known]] + sum(n[known] * d for n, d in zip(follow, by, strict=True)) * p[where]) / total[known]
        if k < model.order:
            sums = [np.zeros(len(part.codes), np.int64) for _ in new]
            for s, values in zip(sums, new, strict=True):
                s[at] = values[which]
    base = np.log10((plain + 1) / (model.tokens + model.words + 1))[part.codes]
    real = part.age > 0
    add = lambda x: np.add.reduceat(np.where(real, x, 0), part.starts)
    return part.size + 1, add((plain > 0)[part.codes].astype(np.int64)), add(base), add(np.log10(p))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row. Rows stay one to one; null and empty texts are an end alone; an empty table gives no rows; a null id isn't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(text, SLICE):
                n, known, base, score = _scored(model, _Slice(text.slice(a, b - a)))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(b - a, model.tokens), pa.int64()), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its log10 probability under a model of the rows that aren't held out; see ``scores`` for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs.where(~held_out())))


#: CRC-32 of an ASCII string ``k``, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(k, '')]), lambda h, b: xor(h >> 8, list_reduce(list_prepend(xor(h, b) & 255, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, o: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END))), 4294967295::UBIGINT)"
_DISCOUNT = "CASE WHEN t1 * t2 * t3 * t4 = 0 THEN [0, 0.5, 1, 1.5]::DOUBLE[] ELSE [0, greatest(0, 1 - 2 * t1 / (t1 + 2 * t2) * t2 / t1), greatest(0, 2 - 3 * t1 / (t1 + 2 * t2) * t3 / t2), greatest(0, 3 - 4 * t1 / (t1 + 2 * t2) * t4 / t3)]::DOUBLE[] END"

SQL = rf"""
WITH k AS (SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS k, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, coalesce({_CRC} % 7 = 2, false) AS held_out, list_append(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS words FROM k),
g AS (SELECT r, held_out, unnest(list_prepend(' start', words[:-2])) AS u, unnest(words) AS w FROM d),
b AS (SELECT u, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY ALL),
c AS (SELECT w, sum(c)::BIGINT AS c, count(*) AS a FROM b GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v, coalesce(sum(a), 0) AS total, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a > 2) AS n3 FROM c),
d1 AS (SELECT {_DISCOUNT} AS one FROM (SELECT count(*) FILTER (a = 1) AS t1, count(*) FILTER (a = 2) AS t2, count(*) FILTER (a = 3) AS t3, count(*) FILTER (a = 4) AS t4 FROM c)),
d2 AS (SELECT {_DISCOUNT} AS two FROM (SELECT count(*) FILTER (c = 1) AS t1, count(*) FILTER (c = 2) AS t2, count(*) FILTER (c = 3) AS t3, count(*) FILTER (c = 4) AS t4 FROM b)),
x AS (SELECT u, sum(c)::BIGINT AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS n3 FROM b GROUP BY u),
p AS (SELECT g.r, c.c, coalesce(c.c, 0) AS plain, CASE WHEN n.total = 0 THEN 1.0 / (n.v + 1) ELSE (greatest(coalesce(c.a, 0) - one[1 + least(coalesce(c.a, 0), 3)], 0) + (n.n1 * one[2] + n.n2 * one[3] + n.n3 * one[4]) / (n.v + 1)) / n.total END AS p1,
        x.total, greatest(coalesce(b.c, 0) - two[1 + least(coalesce(b.c, 0), 3)], 0) AS less, x.n1 * two[2] + x.n2 * two[3] + x.n3 * two[4] AS rest, n.n, n.v
      FROM g CROSS JOIN n CROSS JOIN d1 CROSS JOIN d2 LEFT JOIN c ON c.w = g.w LEFT JOIN x ON x.u = g.u LEFT JOIN b ON b.u = g.u AND b.w = g.w),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((plain + 1) / (n + v + 1))) AS base_score, sum(log10(CASE WHEN total IS NULL THEN p1 ELSE (less + rest * p1) / total END)) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM d JOIN s USING (r)
"""
