"""Divergence audit of sources: how far each source's term rates lie from every other source's of its language.

Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z in lower case.  A language keeps the terms
that stand in at least ``LEAST`` of its documents.  With V kept terms, a group of N kept occurrences gives a term of
``count`` occurrences the rate p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two rates differ by
floor((p - q)^2 / (p + q)).  All of it is integer arithmetic.

Count vectors are packed by vocabulary chunk and replicated to tiles, one for each pair of group blocks and slab of
successive chunks.  A tile holds one chunk of its two blocks at a time and sums its pair submatrix; slabs are summed
by Spark.  Of the terms that no group of a tile has, only the number counts: each adds what two zero counts give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored, table

#: Documents of its language that a term must stand in.
LEAST = 10
#: Groups of a block, counted rows of a vocabulary chunk, chunks of a slab, and bytes of text that are counted at once.
BLOCK, CHUNK, SLAB, SLICE = 16, 16_384, 8, 8 << 20
#: Ranks that the part of terms keeps.
TOP = 10
#: Letters and bytes beyond ASCII stay, A-Z in lower case; all else parts terms.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))
_PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, code) of each term of a column of texts, and what the codes stand for."""
    ends = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if ends[-1] > ends[0] else b""
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype("<i4")), pa.py_buffer(data.translate(_BYTES)))
    lists = pc.ascii_split_whitespace(clean)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    document = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(coded.dictionary, "").as_py()
    return (document, codes, coded.dictionary) if blank < 0 else (document[codes != blank], codes[codes != blank], coded.dictionary)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of slices of the batches; a slice holds whole documents."""
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE)))
            langs, sources = (pc.fill_null(batch.column(c).slice(at, to - at), "").dictionary_encode() for c in ("lang", "source"))
            document, codes, words = _terms(text.slice(at, to - at))
            at = to
            if not len(codes):
                continue
            once, n = np.unique(document * len(words) + codes, return_counts=True)
            group = (langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy())[once // len(words)]
            key = group * len(words) + once % len(words)
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            group, code = key // len(words), key % len(words)
            columns = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), words.take(pa.array(code)), np.add.reduceat(n[order], first), np.diff(np.append(first, len(order)))]
            for i in range(0, len(key), 65_536):
                yield pa.RecordBatch.from_arrays([c.slice(i, 65_536) if isinstance(c, pa.Array) else pa.array(c[i : i + 65_536], pa.int64()) for c in columns], schema=_COUNT)


def rates(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / total) in three steps of a thousand, so that no step leaves 64 bits for totals below 9 * 10^15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + part
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def vectors(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, chunk, items array<(pos, term, n, total)>): each group's counts of kept terms, packed by vocabulary chunk.

    ``pos`` is the term's place in its chunk, ``total`` its occurrences in the language.  A chunk is a hash of the term, so
    a frequent language or source is spread over all of them.
    """
    raw = docs.select(*[F.col(c).cast("string") for c in ("lang", "source", "text")]).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    chunks = max(1, -(-counts.count() // chunk))
    dealt = counts.withColumn("chunk", F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int")).repartition("lang", "chunk")
    one = Window.partitionBy("lang", "chunk", "term")
    kept = dealt.withColumn("total", F.sum("n").over(one)).withColumn("docs", F.sum("docs").over(one)).where(F.col("docs") >= least)
    placed = kept.withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    return stored(placed.groupBy("lang", "chunk", "source").agg(F.collect_list(F.struct("pos", "term", "n", "total")).alias("items")), "term-vectors")


def groups(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(lang, source, n, kept, total, sources): each group's kept occurrences, its language's number of kept terms and of their occurrences, and of sources."""
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = packed.groupBy("lang", "source").agg(F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("n"))
    sizes = packed.groupBy("lang", "chunk").agg(F.max(F.array_max("items.pos")).cast("long").alias("kept")).groupBy("lang").agg(F.sum("kept").alias("kept"))
    each = found.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "kept"])
    lang = each.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    return stored(each.join(lang, "lang"), "term-groups")


class _Tile:
    """The pair submatrix of two group blocks over the chunks of a slab."""

    def __init__(self, lang: str, low: int, high: int, slab: int):
        self.key, self.names, self.sizes, self.blocks = (lang, low, high, slab), [], [], []
        self.kept, self.chunk, self.rows, self.sums = 0, None, [], None

    def add(self, chunk: int | None, block: int, source: str, size: int, kept: int, pos: np.ndarray, n: np.ndarray) -> None:
        if chunk is None:
            self.names.append(source)
            self.sizes.append(size)
            self.blocks.append(block)
            self.kept = kept
            return
        if chunk != self.chunk:
            self._fold()
            self.chunk = chunk
        self.rows.append((self.names.index(source), pos, n))

    def _start(self) -> None:
        if self.sums is None:
            _, low, high, slab = self.key
            self.total = np.array(self.sizes, np.int64) + 2 * self.kept
            block = np.array(self.blocks)
            self.left, self.right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            none = rates(np.full(len(self.total), 2, np.int64), np.maximum(self.total, 1))
            self.none = distances(none[self.left][:, None], none[self.right][None, :])
            self.sums = self.none * (self.kept if slab == 0 else 0)

    def _fold(self) -> None:
        """Adds a chunk: what its terms give in place of two zero counts."""
        if not self.rows:
            return
        self._start()
        terms, at = np.unique(np.concatenate([pos for _, pos, _ in self.rows]), return_inverse=True)
        count = np.zeros((len(self.names), len(terms)), np.int64)
        count[np.repeat([who for who, _, _ in self.rows], [len(pos) for _, pos, _ in self.rows]), at] = np.concatenate([n for _, _, n in self.rows])
        rate = rates(count + 2, self.total[:, None])
        for i, one in enumerate(self.left):
            self.sums[i] += distances(rate[one][None, :], rate[self.right]).sum(1) - len(terms) * self.none[i]
        self.rows = []

    def end(self) -> pa.RecordBatch:
        self._fold()
        self._start()
        lang, low, high, _ = self.key
        pairs = [(self.names[i], self.names[j], int(v)) for x, i in enumerate(self.left) for j, v in zip(self.right, self.sums[x], strict=True) if low != high or i < j]
        a, b, value = zip(*pairs, strict=True) if pairs else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([lang] * len(pairs), a, b, value), _PAIR, strict=True)], schema=_PAIR)


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of tile, chunk (group headers first) give each tile's pairs."""
    tile = None
    for batch in batches:
        names = ("lang", "low", "high", "slab", "chunk", "block", "source", "size", "kept")
        columns = [batch.column(c).to_pylist() for c in names]
        pos, n = batch.column("pos"), batch.column("n")
        for i, (lang, low, high, slab, *rest) in enumerate(zip(*columns, strict=True)):
            if tile is None or tile.key != (lang, low, high, slab):
                if tile is not None:
                    yield tile.end()
                tile = _Tile(lang, low, high, slab)
            tile.add(*rest, pos[i].values.to_numpy(zero_copy_only=False), n[i].values.to_numpy(zero_copy_only=False))
    if tile is not None:
        yield tile.end()


def pairs(packed: DataFrame, sized: DataFrame, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """(lang, a, b, value) of each two sources of a language, each pair once.

    Blocks are a hash of the source.  A group's vector goes to each tile of its block: to as many as its language has blocks.
    """
    most = packed.agg(F.max("chunk")).first()[0]
    slabs = (most or 0) // slab + 1
    blocks = sized.withColumn("blocks", F.ceil(F.col("sources") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    heads = blocks.select("lang", "source", "block", "blocks", F.col("n").alias("size"), "kept", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(None).cast("int").alias("chunk"), F.array().cast("array<int>").alias("pos"), F.array().cast("array<long>").alias("n"))
    counts = packed.join(blocks.select("lang", "source", "block", "blocks"), ["lang", "source"]).select("lang", "source", "block", "blocks", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("kept"), F.expr(f"chunk div {slab}").cast("int").alias("slab"), "chunk", F.col("items.pos").alias("pos"), F.col("items.n").alias("n"))
    other = heads.unionByName(counts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slab", "chunk", "block", "source", "size", "kept", "pos", "n").repartition("lang", "low", "high", "slab")
    sums = tiles.sortWithinPartitions("lang", "low", "high", "slab", "chunk", "source").mapInArrow(_tiled, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def telling(packed: DataFrame, sized: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more often than its language, those that differ most first."""
    rows = packed.select("lang", "source", F.inline("items")).join(sized.select("lang", "source", "kept", F.col("n").alias("of_source"), F.col("total").alias("of_lang")), ["lang", "source"])
    rate = lambda count, of: F.expr(f"1L + (1000000000BD * ({count} + 2)) div ({of} + 2 * kept)")
    both = rows.select("lang", "source", F.col("term").alias("item"), rate("n", "of_source").alias("p"), rate("total", "of_lang").alias("q"))
    over = both.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST, block: int = BLOCK, slab: int = SLAB, chunk: int = CHUNK, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by distance, part ``term`` the ``top`` terms.

    Null lang, source and text count as empty; a group without terms has rates of zero counts; a language that keeps no
    term has distances of 0; rows that are repeated count again; equal values are ordered by the item's bytes; an
    empty table, and a language with one source that keeps no term, give no rows.  Other columns aren't read.
    """
    packed = vectors(docs, least, chunk)
    sized = groups(docs, packed)
    once = pairs(packed, sized, block, slab)
    both = once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(once.select("lang", "b", "a", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    of_pairs = ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    of_terms = telling(packed, sized, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return of_pairs.union(of_terms)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of ``documents``; see ``audit`` for nulls, ties, repeats and empty tables."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE count > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
