"""Sequence packing by the length histogram: shortest pack first, longest lengths first.

Documents are cut into pieces of at most ``limit`` ids.  Only the histogram of piece lengths, at most
``limit`` numbers, goes to the driver.  There lengths are placed from the longest to the shortest, each
into the open pattern with most room, and whole groups of equal patterns are counted rather than single
sequences.  Pieces then find their place by rank: the r-th piece of a length takes the r-th slot of that
length over all patterns.  Ranks come from the task that cut a piece (its part and how many of that length
it had cut before) and from sums over the parts, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import map_batches, stored, table
from .tokens import default_vocabulary, library_encoder


def pack_histogram(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how often each is used; together they hold each length exactly as often as the histogram says."""
    rooms: list[list[list]] = [[] for _ in range(limit + 1)]  # by free room: [pattern, count]
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, room = histogram[length], limit - 1
        while left:
            while room >= length and not rooms[room]:
                room -= 1
            if room < length:
                rooms[limit - length].append([(length,), left])
                break
            group = rooms[room][-1]
            used = min(left, group[1])
            left -= used
            group[1] -= used
            if not group[1]:
                rooms[room].pop()
            rooms[room - length].append([(*group[0], length), used])
            # What was just placed may take the same length once more, but only after all packs that are shorter.
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in rooms:
        for pattern, count in groups:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, slots of that length in a pattern, first sequence, pattern's row in offsets): as many rows as patterns that hold the length."""
    rows: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        starts = np.cumsum([0, *pattern[:-1]]).tolist()
        by_length: dict[int, list[int]] = defaultdict(list)
        for length, start in zip(pattern, starts, strict=True):
            by_length[length].append(start)
        for length, own in by_length.items():  # equal lengths stand side by side
            rows[length].append((ranks[length], len(own), sequence, own[0]))
            ranks[length] += count * len(own)
        sequence += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, limit: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth): the pieces of each document in order, with the rank among those of the same length that this task has cut."""

    def run(batches):
        encoder = library_encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        tail = np.array([end_id], "<u4").tobytes()
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")
        for b in batches:
            out = []
            for key, ids in zip(b["doc_id"], encoder.encode(b["text"]), strict=True):
                data = ids + tail
                n = len(data) // 4
                for at in range(0, n, limit):
                    length = min(limit, n - at)
                    out.append((key, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n, part, seen[length]))
                    seen[length] += 1
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {k: [] for k in names}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long", rows=2048, keep=True)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, limit: int = 2048) -> DataFrame:
    """Packs ``docs(doc_id, text)``: one row for each piece with its sequence and its offset there.

    Null text counts as empty, so each row gives at least the piece that holds its end id.  Rows with
    equal doc_id, repeated whole or not, are separate documents.  An empty table gives no rows.
    """
    cut = stored(pieces(docs, vocabulary, end_id, limit), "pieces")
    by_part = stored(cut.groupBy("part", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `limit` rows
    places = slots(pack_histogram(histogram, limit))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # One row for each part and length: it grows with the input, so it isn't broadcast.
    ranked = cut.join(bases.hint("merge"), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches):
        for b in batches:
            length, rank = np.array(b.pop("length"), np.int64), np.array(b.pop("rank"), np.int64)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own, rows = length == x, places[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 1]
                offset[own] = row[:, 3] + nth % row[:, 1] * x
            yield b | {"length": length, "sequence_id": sequence, "offset": offset}

    return map_batches(ranked, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", rows=8192, keep=True)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each row of ``documents`` with its place in a sequence; see ``pack`` for nulls, repeats and empty tables."""
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
