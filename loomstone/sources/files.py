"""Files of records: numbered text files, literals, JSON records, and the sinks."""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_texts(spark: SparkSession, path: str) -> DataFrame:
    """(qtype, sample_id, text) of <qtype>/<n>.txt files: the folder's name, the file's number, the whole file. Files whose stem is no number have a null id and sort last."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("qtype"), F.expr(r"try_cast(regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS int)").alias("sample_id"), F.col("value").alias("text"))


def benchmark(spark: SparkSession, queries: str, answers: str) -> DataFrame:
    """(qtype, sample_id, query, answer) from two folders of numbered files, joined on their names."""
    q, a = numbered_texts(spark, queries), numbered_texts(spark, answers)
    return q.withColumnRenamed("text", "query").join(a.withColumnRenamed("text", "answer"), ["qtype", "sample_id"])


def aligned(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(qtype, sample_id, one column for each name) of any number of folders of numbered files, read side by side and folded on their names in one shuffle. A file that another folder lacks is an error that names it."""
    every = [numbered_texts(spark, path).withColumn("side", F.lit(name)) for name, path in folders.items()]
    rows = reduce(DataFrame.union, every).groupBy("qtype", "sample_id").agg(*[F.max(F.when(F.col("side") == n, F.col("text"))).alias(n) for n in folders])
    lacking = F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.lit(n)) for n in folders])
    checked = F.when(lacking == "", F.col("qtype")).otherwise(F.raise_error(F.format_string("%s/%d is not in %s", F.col("qtype"), F.col("sample_id"), lacking)))
    return rows.select(checked.alias("qtype"), "sample_id", *folders)


def literal_json(text: Column) -> Column:
    """A JSON or Python literal as JSON text; null where it is neither. Tuples and sets become arrays, sets in order."""

    def one(x):
        if not isinstance(x, str):
            return None
        try:
            return json.dumps(json.loads(x))
        except (ValueError, RecursionError):
            pass
        try:
            return json.dumps(_plain(ast.literal_eval(x)))
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return convert(text)


def _plain(x):
    if isinstance(x, (set, frozenset)):
        return sorted((_plain(i) for i in x), key=lambda i: (str(type(i)), i))
    if isinstance(x, (list, tuple)):
        return [_plain(i) for i in x]
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return x


def legacy_results(df: DataFrame, text_col: str = "text", parts: int = 2) -> DataFrame:
    """Adds ``parts``: a result file's predictions, one for each stage, and its gold, without white space around them. They stand apart by two ``@`` with nothing but white space between. A file with another number of parts fails."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    split = F.transform(F.split(trimmed(F.col(text_col)), r"@\s*@", -1), trimmed)
    return df.withColumn("parts", F.when(F.size(split) == parts, split).otherwise(F.raise_error(F.lit(f"a result without {parts} parts"))))


def staged_answers(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each stage of a staged answer record: stage, answer, raw_answer, confidence, status. Lists of unequal length fail."""
    r = F.from_json(text_col, "answers array<string>, raw_answers array<string>, confidences array<string>, status string")
    rows = df.withColumn("r", r)
    ok = (F.size("r.answers") == F.size("r.raw_answers")) & (F.size("r.answers") == F.size("r.confidences"))
    rows = rows.withColumn("zipped", F.when(ok, F.arrays_zip("r.answers", "r.raw_answers", "r.confidences")).otherwise(F.raise_error(F.lit("lists of unequal length"))))
    keep = [c for c in df.columns if c != text_col]
    return rows.select(*keep, "r.status", F.posexplode("zipped").alias("stage", "z")).select(*keep, (F.col("stage") + 1).alias("stage"), F.col("z.answers").alias("answer"), F.col("z.raw_answers").alias("raw_answer"), F.col("z.confidences").alias("confidence"), "status")


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines, in folders by the given columns."""
    (df.write.partitionBy(*by) if by else df.write).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mark: bool = False) -> None:
    """One CSV of a small summary, columns in the given order, arrays as JSON text; with ``mark`` the header begins with a byte-order mark, as spreadsheets expect."""
    flat = [F.to_json(c).alias(c) if dict(df.dtypes)[c].startswith(("array", "map", "struct")) else F.col(c) for c in columns]
    out = df.select(*flat)
    if mark:
        out = out.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    out.coalesce(1).write.option("header", True).csv(path)


def write_samples(df: DataFrame, path: str, by: tuple[str, ...] = ("method", "qtype")) -> None:
    """One JSON record for each sample, in folders by method and topology; a sample's id is a field of its record. Rows are dealt out by ranges of all that has an order, so that a large folder is written by several tasks."""
    order = [*by, *[f.name for f in df.schema if f.name not in by and not isinstance(f.dataType, (T.MapType, T.VariantType))]]
    df.repartitionByRange(*order).sortWithinPartitions(*by).write.partitionBy(*by).json(path)


def write_pretty(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small summary as one indented JSON array; more than ``most`` rows fail."""
    held = df.agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    few = F.when(F.size("rows") <= most, F.col("rows")).otherwise(F.raise_error(F.lit("a report is made of a summary, not of data")))
    held.select(F.to_json(few, {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A table of a small summary in Markdown; more than ``most`` rows fail instead of filling the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is made of a summary, not of data")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    show = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def report(title: str, sections: list[tuple[str, str | DataFrame]], most: int = 10_000) -> str:
    """A report in Markdown: sections in order, each a text or a table of a small summary."""
    parts = [f"# {title}\n"] + [markdown(body, head, most) if isinstance(body, DataFrame) else f"## {head}\n\n{body}\n" for head, body in sections]
    return "\n".join(parts)
