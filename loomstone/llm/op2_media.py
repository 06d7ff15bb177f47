"""Media columns: MPEG audio kept as binary, with exact durations and seek offsets beside it."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mpeg
from .scratch import map_batches, stored, table

INFO = "duration_s double, samples long, sample_rate int, frames int, offsets array<long>, tags map<string,string>, vbr_kind string, vbr_frames long, vbr_bytes long, toc array<long>, crc_checked int, crc_failed int, resyncs int, skipped_bytes long"


def _described(a: mpeg.Audio) -> tuple:
    v = a.vbr or {}
    return (a.seconds, a.samples, a.rate, len(a.offsets), a.offsets, list(a.tags.items()), v.get("kind"), v.get("frames"), v.get("bytes"), v.get("toc"), a.checked, a.failed, a.resyncs, a.skipped)


def describe(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, duration, frame offsets, tags, table, checksums, resynchronisations) of each audio value.

    Null, empty or frameless bytes give no frames, zero samples and a duration of 0.  Rows stay one to one.
    """
    names = [c.split()[0] for c in INFO.split(", ")]

    def run(batches):
        for b in batches:
            rows = [_described(mpeg.parse(data or b"")) for data in b["media"]]
            yield {"id": b["id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    kind = media.schema[id_col].dataType.simpleString()
    return map_batches(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), run, f"id {kind}, {INFO}").withColumnRenamed("id", id_col)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, and what ``describe`` says of it): each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, in frames of audio, beside their exact duration and the byte offset of each frame.

    Null counts as empty.  Rows stay one to one, equal texts give equal bytes, an empty table gives no rows.
    """
    names = [c.split()[0] for c in INFO.split(", ")]

    def run(batches):
        for b in batches:
            data = [(t or "").encode() for t in b["text"]]
            media = [mpeg.write(d + b" " * (-len(d) % mpeg.UNIT or (0 if d else mpeg.UNIT)), len(d)) for d in data]
            rows = [_described(mpeg.parse(m)) for m in media]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(d) for d in data], "media": media} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, n_bytes long, media binary, {INFO}", rows=128)


def features(media: DataFrame) -> DataFrame:
    """What the stored rows of ``store_texts`` say: digests of the payload, read back frame by frame at the stored offsets, a feature string, durations and offsets.

    The tail comes by seeking to the last frame alone.  A frame whose checksum fails is an error, not a payload.
    """

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for i, data in enumerate(b["media"]):
                offsets, tags = b["offsets"][i], dict(b["tags"][i])
                back = mpeg.payload(data, offsets)
                tail = mpeg.payload(data, offsets[-1:])[-16:]
                feature = f"mpeg1 layer3 {b['sample_rate'][i]} Hz; {b['duration_s'][i]:.3f} s; samples {b['samples'][i]}; frames {len(offsets)} of {b['vbr_frames'][i]}; {b['vbr_kind'][i]} {b['vbr_bytes'][i]} bytes; crc {b['crc_checked'][i] - b['crc_failed'][i]}/{b['crc_checked'][i]}; resyncs {b['resyncs'][i]}; TLEN {tags['TLEN']}; TSIZ {tags['TSIZ']}; last frame at {offsets[-1]}"
                for k, v in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature), strict=True):
                    out[k].append(v)
            yield {k: b[k] for k in ("doc_id", "n_bytes")} | out | {k: b[k] for k in ("duration_s", "offsets")}

    return map_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, offsets array<long>", rows=128)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` as stored audio, and what is read back of it; see ``store_texts`` for nulls, repeats and empty tables."""
    return features(stored(store_texts(table(spark, sf_dir, "documents")), "media"))
