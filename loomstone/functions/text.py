"""Extraction from prompts and answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of triples and of ids in questions.
TRIPLE = r"\(\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\)"
SIGNED_TRIPLE = r"\(\s*-?[0-9]+\s*,\s*-?[0-9]+\s*,\s*-?[0-9]+\s*\)"
QUESTION_ENTITY = r"(?i)connected to (?:entity )?([0-9]+)"
AUDITED_ENTITY = r"(?i)connected\s+to(?:\s+entity|\s+entities\s+in)?\s+([0-9]+)"
QUESTION_RELATION = r"(?i)by relation ([0-9]+)"
ANY_RELATION = r"(?i)by (?:relation )?([0-9]+)"
NUMBER = r"\b[0-9]+\b"


def triples(text: Column, signed: bool = False) -> Column:
    """array<struct<h,r,t>> of the triples in a text, in order, repeats kept. Null for null; an id of more digits than its type holds is null."""
    found = F.regexp_extract_all(text, F.lit(SIGNED_TRIPLE if signed else TRIPLE), 0)
    parts = lambda m: F.split(F.regexp_replace(m, r"[()\s]", ""), ",")
    return F.transform(found, lambda m: F.struct(parts(m)[0].try_cast("long").alias("h"), parts(m)[1].try_cast("int").alias("r"), parts(m)[2].try_cast("long").alias("t")))


def question_entities(text: Column, audited: bool = False) -> Column:
    """Entities that a question starts from; audits also read ``entities in`` and any white space."""
    return F.transform(F.regexp_extract_all(text, F.lit(AUDITED_ENTITY if audited else QUESTION_ENTITY), 1), lambda x: x.try_cast("long"))


def question_relations(text: Column, bare: bool = False) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ANY_RELATION if bare else QUESTION_RELATION), 1), lambda x: x.try_cast("int"))


def numbers(text: Column) -> Column:
    """array<string>: the distinct digit runs of a text, by value and then as they are written. They stay text, so runs of any length count; null for null."""
    plain = lambda x: F.regexp_replace(x, "^0+", "")
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), 0))
    return F.transform(F.array_sort(F.transform(runs, lambda x: F.struct(F.length(plain(x)).alias("n"), plain(x).alias("v"), x.alias("x")))), lambda s: s["x"])


def before(text: Column, marker: str, strict: bool = True) -> Column:
    """What stands before the first marker. Without one: an error, or the whole text if not strict."""
    found = F.substring_index(text, marker, 1)
    return F.when(F.contains(text, F.lit(marker)), found).otherwise(F.raise_error(F.lit(f"no {marker!r}")) if strict else text)


def after(text: Column, marker: str, strict: bool = True) -> Column:
    """What stands after the first marker."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.substr(text, at + len(marker))).otherwise(F.raise_error(F.lit(f"no {marker!r}")) if strict else text)


def final_answer(text: Column) -> Column:
    """The body of the last ``Answer: {...}``, else what follows the last ``Answer:``, else null."""
    braces = F.regexp_extract_all(text, F.lit(r"(?s)Answer:\s*\{(.*?)\}"), 1)
    return F.when(F.size(braces) > 0, F.element_at(braces, -1)).when(F.contains(text, F.lit("Answer:")), F.trim(F.substring_index(text, "Answer:", -1)))


def strict_set(text: Column) -> Column:
    """array<bigint>: null for blank or malformed text, empty for None, else the distinct sorted integers."""
    t = F.trim(text)
    items = F.split(t, r"\s*,\s*")  # item by item: one expression over a long list overflows the matcher's stack
    return F.when(t.isNull() | (t == ""), None).when(t == "None", F.array().cast("array<bigint>")).when(F.forall(items, lambda x: x.rlike("^-?[0-9]+$")), F.array_sort(F.array_distinct(F.transform(items, lambda x: x.try_cast("long")))))


def lenient_set(text: Column) -> Column:
    """array<string>: braces gone, blank and None items skipped, distinct and sorted; empty for null."""
    items = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), "{}", ""), ","), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: (x != "") & (F.lower(x) != "none"))))


def checked_set(text: Column) -> Column:
    """array<bigint>: empty for null, blank, None and NULL; malformed text fails."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", "NONE", "NULL"), F.array().cast("array<bigint>")).otherwise(F.coalesce(strict_set(text), F.raise_error(F.concat(F.lit("no answer set: "), text)).cast("array<bigint>")))


def api_answer(text: Column) -> Column:
    """array<string>: the answer field of the JSON object in a reply, empty on any error."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "answer array<string>")["answer"], F.array().cast("array<string>"))


def last_answer_list(text: Column) -> Column:
    """array<string>: the last ``"answer": [...]`` of a reply."""
    found = F.regexp_extract_all(text, F.lit(r'(?s)"answer"\s*:\s*(\[.*?\])'), 1)
    return F.when(F.size(found) > 0, F.from_json(F.element_at(found, -1), "array<string>")).otherwise(F.array().cast("array<string>"))


def bare(text: Column) -> Column:
    """A gold answer without braces and spaces."""
    return F.translate(text, "{} ", "")


def relation_key(predicate: Column, direction: Column) -> Column:
    return F.concat_ws("::", predicate, direction)


def relation_parts(key: Column) -> Column:
    """struct<predicate,direction> of a key; the direction is what stands behind the last ``::``."""
    pattern = r"^(.*)::([^:]*)$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("predicate"), F.regexp_extract(key, pattern, 2).alias("direction"))


def rounded_text(value: Column) -> Column:
    """A measure as text, rounded to four places and without an exponent, trailing zeros cut behind the first; a negative one that rounds to zero is -0.0."""
    digits = F.regexp_replace(F.round(value, 4).try_cast("decimal(38,4)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.when((value < 0) & (F.round(value, 4) == 0), "-0.0").otherwise(digits)


def four_places(value: Column) -> Column:
    """A measure as text with four places; NA for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "NA").otherwise(F.format_string("%.4f", value))
