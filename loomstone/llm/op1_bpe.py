"""Byte-pair encoding and decoding of text columns by the streaming transducer in ``bpe``."""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .scratch import map_batches, table
from .tokens import default_vocabulary

#: Characters that the machine takes at a time.
PIECE = 4096


def _streams(v: bpe.Vocabulary, text: str | None):
    """Ids of a text, as they become final."""
    yield from bpe.encode_pieces(v, (text[i : i + PIECE] for i in range(0, len(text or ""), PIECE)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; null or empty text gives an empty array. Rows stay one to one; equal ids may repeat."""

    def run(batches):
        v = bpe.vocabulary(path)
        for b in batches:
            yield {"id": b["id"], "ids": [array("I", b"".join(_streams(v, t))).tolist() for t in b["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", surface: bool = True) -> DataFrame:
    """(id, text): vocabulary strings joined by one space, or the bytes that the ids stand for with ``surface=False``; null ids count as none."""

    def run(batches):
        v = bpe.vocabulary(path)
        for b in batches:
            out = []
            for row in b["ids"]:
                machine = bpe.Decoder(v, surface)
                out.append(machine.feed(array("I", row or []).tobytes()) + machine.end())
            yield {"id": b["id"], "text": out}

    kind = ids.schema[id_col].dataType.simpleString()
    return map_batches(ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """For each row: number of ids, SHA-256 of the decimal ids and of the decoded text. Both sums take the stream piece by piece, so neither ids nor decoded text of a whole document are held.

    Null and empty texts have no ids and the sums of empty strings.  Rows stay one to one, equal texts get equal sums,
    an empty table gives no rows.
    """

    def run(batches):
        v = bpe.vocabulary(path)
        decimal = [str(i).encode() for i in range(max(v.surface) + 1)]
        for b in batches:
            counts, ids_sums, text_sums = [], [], []
            for text in b["text"]:
                n, ids_sum, text_sum, machine = 0, hashlib.sha256(), hashlib.sha256(), bpe.Decoder(v)
                for part in _streams(v, text):
                    if part:
                        ids = array("I", part)
                        ids_sum.update((b" " if n else b"") + b" ".join(map(decimal.__getitem__, ids)))
                        text_sum.update(machine.feed(part).encode())
                        n += len(ids)
                text_sum.update(machine.end().encode())
                counts.append(n)
                ids_sums.append(ids_sum.hexdigest())
                text_sums.append(text_sum.hexdigest())
            yield {"doc_id": b["doc_id"], "n_tokens": counts, "ids_sha256": ids_sums, "decoded_sha256": text_sums}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its number of ids and the digests of its ids and decoded text; see ``digests`` for nulls, repeats and empty tables."""
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())
