"""Edits of texts by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_batches


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, u, text): what tells a row's text from others of its doc_id, null or not, is two 64-bit hashes."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), F.col("text")).alias("u"), "text")


def edited(text: str, edits: list) -> str:
    """A text with stretches replaced; ``edits`` are (start, end, put), in order and apart."""
    out, at = [], 0
    for start, end, put in edits:
        out += (text[at:start], put)
        at = end
    out.append(text[at:])
    return "".join(out)


def rewrite(docs: DataFrame, edits: DataFrame, keys: dict | None = None) -> DataFrame:
    """``docs`` with ``text`` edited and ``n_chars`` set anew, columns in the same order, whatever their names.

    ``edits`` has doc_id, keys of the text, start, end and put: what replaces a stretch of the text.  ``keys`` are the names
    of the text's keys and how they come from ``text``, those of ``keyed`` if none are given.  Rows without
    edits and null texts stay as they are; rows that are repeated whole are edited alike.  One shuffle
    brings texts and edits together.
    """
    keys = keys or {"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), F.col("text"))}
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(*own).alias("row"), "doc_id", *[k.alias(n) for n, k in keys.items()])
    listed = edits.groupBy(F.col("doc_id").alias("own_id"), *[F.col(n).alias(f"own_{n}") for n in keys]).agg(F.sort_array(F.collect_set(F.struct("start", "end", "put"))).alias("edits"))
    same = rows["doc_id"].eqNullSafe(listed["own_id"])
    for n in keys:
        same = same & (rows[n] == listed[f"own_{n}"])
    both = rows.join(listed, same, "left").select("row.*", "edits")
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    text = f"c{docs.columns.index('text')}"
    size = f"c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            for i, found in enumerate(b.pop("edits")):
                if found and b[text][i] is not None:
                    b[text][i] = edited(b[text][i], [(e["start"], e["end"], e["put"]) for e in found])
                    if size:
                        b[size][i] = len(b[text][i])
            yield b

    return map_batches(both, run, kinds).toDF(*docs.columns)
