"""Order MinHash fingerprints in column expressions alone.

A text is a sequence of symbols: a run of at most ``RUN`` characters without white space, a piece of a longer run, or
one character of a script that is written without spaces.  Longer runs are cut behind the characters of ``CUTS``, three
characters apart at least and ``LONGEST`` at most, so what they are cut into follows from what stands there and not from
where the run began: an edit changes the pieces around it.  The rule is the same at every length.  Each run of K symbols
is a k-mer; a k-mer's n-th occurrence in the text counts as a k-mer of its own.  The hashes of these
occurrence-numbered k-mers fall into ``BINS`` bins by their upper bits.  In each bin the two smallest are
selected, put in the order in which they stand in the text, and hashed as a tuple.  So a bin of two
fingerprints agrees only if both texts select the same k-mers in the same order, which is what makes the
share of agreeing bins fall with edit distance and not only with the overlap of k-mer sets.

Everything is done inside a row by array functions: two sorts of packed longs, no explosion and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored, table

K, BINS, RUN, LONGEST = 3, 32, 8, 16
#: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: ASCII's visible characters first: most characters are told by the first range alone.
_RUN = rf"[!-~[^\s\u00a0\u3000{_UNSPACED}]]"
#: Behind which a long run is cut: every sixth character of Latin-1, and some vowels of Greek and Cyrillic.
CUTS = "".join(rf"\x{c:02x}" for c in range(0x21, 0x100) if c % 6 == 1) + r"\u03b1\u03bf\u0430\u043e"
#: A symbol doesn't begin with a space or a line's end, which is looked at first.
SYMBOL = rf"(?=[^ \n])(?:{_RUN}{{1,{RUN}}}+(?!{_RUN})|{_RUN}{{2,{LONGEST - 1}}}?[{CUTS}]|{_RUN}{{1,{LONGEST}}}|[{_UNSPACED}])"
#: A packed long: the hash in the upper 37 bits below the sign, the position in the lower 26.
POSITION_BITS, HASH_BITS = 26, 37
BIN_SHIFT = POSITION_BITS + HASH_BITS - 5
NONE = "----"


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column: BINS groups of four hex digits, or ``----`` where no k-mer fell.

    Null counts as empty; an empty or blank text has no k-mer and its fingerprint is all dashes.  A text of fewer
    than K symbols is one k-mer.  Equal texts have equal fingerprints.  Rows stay one to one, an empty table gives
    no rows.  Columns of ``df`` may have any names.
    """
    keep, own = df.columns, "__"
    while any(c.lower().startswith(own) for c in keep):
        own += "_"
    mask = (1 << HASH_BITS) - 1

    def pack(h: str, position: str) -> str:
        return f"shiftleft({h} & {mask}L, {POSITION_BITS}) | cast({position} AS bigint)"

    df = df.withColumn(f"{own}s", F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(SYMBOL), F.lit(0)))
    steps = {
        "__n": "size(__s)",
        "__k": f"if(__n >= {K}, transform(sequence(0, greatest(__n - {K}, 0)), i -> {pack('xxhash64(__s[i], __s[i + 1], __s[i + 2])', 'i')}), if(__n = 0, cast(array() AS array<bigint>), array({pack('xxhash64(array_join(__s, chr(0)))', '0')})))",
        "__k2": "sort_array(__k)",
        "__r": f"filter(transform(__k2, (x, i) -> if(i > 0 AND shiftright(x, {POSITION_BITS}) = shiftright(__k2[greatest(i - 1, 0)], {POSITION_BITS}), -1, i)), i -> i >= 0)",
        "__v": f"if(size(__r) = size(__k2), transform(__k2, x -> {pack(f'xxhash64(shiftright(x, {POSITION_BITS}), 0)', f'(x & {(1 << POSITION_BITS) - 1}L)')}), "
        f"flatten(transform(__r, (s, j) -> transform(sequence(s, coalesce(get(__r, j + 1), size(__k2)) - 1), p -> {pack(f'xxhash64(shiftright(__k2[p], {POSITION_BITS}), p - s)', f'(__k2[p] & {(1 << POSITION_BITS) - 1}L)')}))))",
        "__v2": "sort_array(__v)",
        "__b": f"filter(transform(__v2, (x, i) -> if(i > 0 AND shiftright(x, {BIN_SHIFT}) = shiftright(__v2[greatest(i - 1, 0)], {BIN_SHIFT}), -1, i)), i -> i >= 0)",
        "__t": f"""transform(__b, s -> struct(shiftright(__v2[s], {BIN_SHIFT}) AS bin, lower(lpad(hex(
            CASE WHEN s + 1 >= size(__v2) OR shiftright(__v2[least(s + 1, size(__v2) - 1)], {BIN_SHIFT}) <> shiftright(__v2[s], {BIN_SHIFT}) THEN xxhash64(shiftright(__v2[s], {POSITION_BITS}))
                 WHEN (__v2[s] & {(1 << POSITION_BITS) - 1}L) < (__v2[s + 1] & {(1 << POSITION_BITS) - 1}L) THEN xxhash64(shiftright(__v2[s], {POSITION_BITS}), shiftright(__v2[s + 1], {POSITION_BITS}))
                 ELSE xxhash64(shiftright(__v2[s + 1], {POSITION_BITS}), shiftright(__v2[s], {POSITION_BITS})) END & 65535L), 4, '0')) AS h))""",
        "__f": "map_from_entries(__t)",
        # The size is asked for only so that the map is built once: named once, it would be built anew for each bin.
        "__out": f"if(size(__f) < 0, NULL, array_join(transform(sequence(0L, {BINS - 1}L), b -> coalesce(try_element_at(__f, b), '{NONE}')), ''))",
    }
    for name, expression in steps.items():
        df = df.withColumn(name.replace("__", own), F.expr(expression.replace("__", own)))
    return df.select(*[F.col(f"`{c}`") for c in keep if c != out], F.col(f"{own}out").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with the same tuple, of the bins that hold a k-mer in either; 1 where neither has any."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(F.substr(a, i * 4 + 1, F.lit(4)).alias("a"), F.substr(b, i * 4 + 1, F.lit(4)).alias("b")))
    used = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
    same = F.filter(used, lambda p: p["a"] == p["b"])
    return F.when(F.size(used) == 0, 1.0).otherwise(F.size(same) / F.size(used))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and likenesses with that and with the next document's.

    ``docs`` has (doc_id, text).  The next document is that of the next larger doc_id; after the largest
    comes the smallest.  Null text counts as empty, a null doc_id comes first.  Rows with an equal doc_id
    stay separate, have the same next document, and stand as next with their smallest text.  An only document is
    its own next; an empty table gives no rows.

    Texts cross the cluster once, dealt out by doc_id; that exchange serves both as the document and as
    the next document of another.  The successor table holds ids and lengths only.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"))
    base = docs.select(key.alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = with_fingerprint(base)
    sizes = base.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    ids = stored(sizes.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "ids")
    # One row for each range of ids: where the next range begins.
    firsts = ids.groupBy("part").agg(F.min("k").alias("k"))
    onward = firsts.select("part", F.coalesce(F.lead("k").over(Window.orderBy("part")), F.min("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("onward"))
    following = ids.join(F.broadcast(onward), "part").select(F.col("k").alias("own"), F.coalesce(F.lead("k").over(Window.partitionBy("part").orderBy("k")), "onward").alias("next_k"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    heads = printed
    if ids.where("copies > 1").limit(1).count():  # one row must stand for an id
        heads = printed.groupBy("k").agg(F.min_by(F.struct("doc_id", "text", "fingerprint"), "text").alias("r")).select("k", "r.*")
    heads = heads.join(following, heads["k"] == following["next_k"]).select(F.col("own"), F.col("doc_id").alias("next_doc_id"), F.substr("text", F.lit(1), F.col("need")).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    joined = printed.join(heads, printed["k"] == heads["own"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = joined.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_doc_id", "next_fingerprint", F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("head", F.lit(1), quarter)).alias("edited"))
    both = with_fingerprint(edited, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "next_doc_id",
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its fingerprint and likenesses; see ``edited_and_next`` for nulls, repeats and empty tables."""
    return edited_and_next(table(spark, sf_dir, "documents"))
