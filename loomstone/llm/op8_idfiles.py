"""Token-id files: documents' ids in order of their key, Simple-8b coded, with per-block offsets.

The files are a Parquet folder whose rows are segments.  A segment holds whole documents: their keys,
their numbers of ids, the words of the code, the word offset of each block of 4,096 ids, and where the
segment starts in its part.  Parts are ranges of the key, so a document's global start is the sum of
the parts before (one number for each part), the segment's start in its part and the counts before it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .scratch import map_batches, shared_dir, table
from .tokens import default_vocabulary, library_encoder

SEGMENT = "part int, start_in_part long, n_ids long, doc_ids binary, missing binary, counts binary, offsets binary, words binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, segment_ids: int = 1 << 17) -> None:
    """Encodes ``docs(doc_id long, text)``, appends ``end_id`` to each document and writes the segments.

    One shuffle deals the texts out by ranges of doc_id and text hash, so many rows of one id or without one are split.
    Null text counts as empty; a null doc_id comes first; rows with equal doc_id stay separate and are ordered by the
    hash of their text, then by the text; an empty table gives no rows.
    """

    def run(batches):
        encoder = library_encoder(vocabulary)
        part, start = TaskContext.get().partitionId(), 0
        keys, counts, held, total = [], [], [], 0
        tail = np.array([end_id], "<u4").tobytes()

        def segment():
            ids = np.frombuffer(b"".join(held), "<u4")
            words, offsets = simple8b.encode(ids)
            return {
                "part": [part],
                "start_in_part": [start],
                "n_ids": [total],
                "doc_ids": [np.array([k or 0 for k in keys], "<i8").tobytes()],
                "missing": [bytes(k is None for k in keys)],
                "counts": [np.array(counts, "<u8").tobytes()],
                "offsets": [offsets.astype("<u4").tobytes()],
                "words": [words.astype("<u8").tobytes()],
            }

        for b in batches:
            for key, ids in zip(b["doc_id"], encoder.encode(b["text"]), strict=True):
                keys.append(key)
                counts.append(len(ids) // 4 + 1)
                held += (ids, tail)
                total += counts[-1]
                if total >= segment_ids:
                    yield segment()
                    start += total
                    keys, counts, held, total = [], [], [], 0
        if keys:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("t", F.xxhash64("text")).repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t", "text")
    map_batches(ordered.select("doc_id", "text"), run, SEGMENT, rows=2048, keep=True).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, crc_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids unless ``crc_only``) from the files alone.

    The starts of the parts are broadcast: two numbers for each part of the write, whatever the size of the data.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start_in_part")).alias("start"), "n_ids", "doc_ids", "missing", "counts", "offsets", "words")

    def run(batches):
        for b in batches:
            for i in range(len(b["start"])):
                counts = np.frombuffer(b["counts"][i], "<u8").astype(np.int64)
                ids = simple8b.decode(np.frombuffer(b["words"][i], "<u8"), np.frombuffer(b["offsets"][i], "<u4"), b["n_ids"][i]).astype("<u4")
                ends = np.cumsum(counts)
                data = memoryview(ids.tobytes())
                keys = np.frombuffer(b["doc_ids"][i], "<i8").tolist()
                out = {
                    "doc_id": [None if m else k for k, m in zip(keys, b["missing"][i], strict=True)],
                    "start": (b["start"][i] + ends - counts).tolist(),
                    "n_tokens": counts.tolist(),
                    "ids_crc32": [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)],
                }
                if not crc_only:
                    out["ids"] = [ids[e - c : e].tolist() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield out

    return map_batches(joined, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if crc_only else ", ids array<long>"), rows=4, keep=True)


def op8_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with the place, number and checksum of its ids, read back from the files; see ``write_ids`` for nulls, repeats and empty tables."""
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return read_ids(spark, path, crc_only=True)
