"""Repair of conversation structure: the cheapest edits that make a conversation's roles follow a grammar.

The grammar is ``(s?(ua)+)?`` over role initials.  Keep costs nothing, Rerole (to user or assistant) 2, Delete 3, Insert
(an empty user or assistant turn, anywhere) 2; a truncated turn that isn't deleted adds 1; blank and repeated turns must go.
Of equally cheap edits the ASCII-least string of their initials wins.  No two equally cheap strings up to the same turn
and state start one another, because the letters alone fix the cost; so the least string of each state is enough.

Turns are dealt out in order by ranges and cut into segments of ``SEGMENT`` turns.  In each batch a DuckDB recursive
query advances all segments by one turn a step and keeps, for each state it may be entered in and each state it may
be in, the least cost and its string.  A conversation that lies in one segment is finished there.  The segments of the
others are folded in order by a pass that holds one string and one running hash for each state, so a conversation of
any length is spread over tasks and nothing but its own string is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored, table

#: Turns of a segment, and of a batch.
SEGMENT, BATCH = 128, 4096
#: Grammar states: nothing yet, after system, after user, after assistant. What an insert or a rerole makes of each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: A turn's first fault.
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
_SPACE = r"\x20\x09-\x0D"
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _inserted(state: int, most: int) -> list[tuple[int, int]]:
    """(inserts, state) from a state; more than two in a row lead nowhere that fewer don't."""
    out = [(0, state)]
    for n in range(1, most + 1):
        state = NEXT[state]
        out.append((n, state))
    return out


def moves() -> list[tuple[int, str, str, int, int]]:
    """(state before, the turn's initial or '' for any, letters, state after, cost): some inserts and then what becomes of the turn."""
    out = []
    for was in range(4):
        for n, at in _inserted(was, 2):
            before, cost = "I" * n, INSERT * n
            out += [(was, initial, before + "K", to, cost + KEEP) for (state, initial), to in KEEPS.items() if state == at]
            out += [(was, "", before + "R", NEXT[at], cost + REROLE), (was, "", before + "D", at, cost + DELETE)]
    return out


def closed(state: int) -> str:
    """The inserts that end a conversation well."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def replayed(state: int, audit: str, turns: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired turns ``role:text`` of a string of edits that begins in a state."""
    at = iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            state = KEEPS[state, role[:1]]
        else:
            state = NEXT[state]
            role = _NAMES[state]
        yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, row, copy, gone): rows damaged by the checksum of ``conv_id:turn``; rows that are dropped stay as gone, so that no conversation is lost."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), fate.alias("fate"), F.monotonically_increasing_id().alias("row"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "row", F.explode(copies).alias("copy"), (F.col("fate") == 0).alias("gone"))


def as_they_are(rows: DataFrame) -> DataFrame:
    """The columns of ``damaged`` for rows that aren't to be damaged."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role"), named("text"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def faulted(turns: DataFrame) -> DataFrame:
    """``turns`` with each row's first ``fault``. Only what stands more than once in a conversation is joined back, so a text that fills a conversation is folded before it moves."""
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")]
    place = F.struct("turn", "row", "copy")
    here = turns.where("NOT gone")
    firsts = here.groupBy("conv_id", "role", *hashes).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    mine = turns.select("*", *hashes, place.alias("place"))
    firsts = firsts.select(F.col("conv_id").alias("its_conv"), F.col("role").alias("its_role"), F.col("h").alias("its_h"), F.col("g").alias("its_g"), "first")
    both = mine.join(firsts, mine["conv_id"].eqNullSafe(F.col("its_conv")) & (mine["role"] == F.col("its_role")) & (mine["h"] == F.col("its_h")) & (mine["g"] == F.col("its_g")), "left")
    fault = (
        F.when(F.col("gone"), GONE).when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(F.col("first").isNotNull() & ~F.col("place").eqNullSafe(F.col("first")), DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), TRUNCATED).otherwise(FINE)
    )
    return both.select("conv_id", "turn", "role", "text", "row", "copy", fault.cast("int").alias("fault"))


_WALK = f"""
WITH RECURSIVE walk AS (
  SELECT seg, state AS entry, state, 0 AS i, 0::BIGINT AS cost, '' AS audit FROM opens
  UNION ALL
  SELECT seg, entry, state, i, best.cost, best.audit FROM (
    SELECT w.seg, w.entry, m.state, w.i + 1 AS i, min({{'cost': w.cost + m.cost + CASE WHEN t.fault = {TRUNCATED} AND m.last <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || m.letters}}) AS best
    FROM walk w JOIN turns t ON t.seg = w.seg AND t.i = w.i
    JOIN moves m ON m.was = w.state AND (m.last = 'D' OR t.fault NOT IN ({BLANK}, {DUPLICATE}) AND (m.last = 'R' OR m.initial = t.initial))
    GROUP BY w.seg, w.entry, m.state, w.i))
SELECT walk.seg, entry, state, cost, audit FROM walk JOIN segs ON segs.seg = walk.seg AND segs.size = walk.i ORDER BY walk.seg, entry, state
"""
_COUNTS = f"""
SELECT seg, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns,
  arg_min(initial, i) AS head, arg_max(initial, i) AS tail
FROM (SELECT *, lag(initial) OVER (PARTITION BY seg ORDER BY i) AS before FROM turns) GROUP BY seg
"""
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTED = ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "head", "tail")
_KINDS = "part int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head string, tail string, paths array<struct<entry:int,state:int,cost:long,audit:string>>, roles array<string>, texts array<string>, sha string"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _best(paths: dict) -> tuple[int, int, str]:
    """(state, cost, audit) of the cheapest way to the end of a conversation, of {state: (cost, audit)}."""
    ended = [(cost + INSERT * len(closed(state)), audit + closed(state), state) for state, (cost, audit) in paths.items()]
    cost, audit, state = min(ended)
    return state, cost, audit


def segments(turns: DataFrame, segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """A row for each segment: its conversation, its place, its counts and its cheapest paths; those of whole conversations have the repaired text's hash, the others their turns."""
    kind = turns.schema["conv_id"].dataType
    ordered = turns.repartitionByRange("conv_id", "turn", "role", "text", "row", "copy").sortWithinPartitions("conv_id", "turn", "role", "text", "row", "copy")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        con.execute("CREATE TABLE moves(was INTEGER, initial VARCHAR, letters VARCHAR, state INTEGER, cost BIGINT, last VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", [(*m, m[2][-1]) for m in moves()])
        part, seq, before = TaskContext.get().partitionId(), 0, []
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                rows = whole.slice(at, batch)
                yield from _walked(con, rows, before, segment, part, seq)
                before, seq = [rows.column("conv_id")[-1].as_py()], seq + rows.num_rows
        con.close()

    fields = [("conv_id", None), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), *[(c, pa.string() if c in ("head", "tail") else pa.int64()) for c in _COUNTED], ("paths", _PATHS), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("sha", pa.string())]

    def _walked(con, rows, before, segment, part, seq):
        conv = rows.column("conv_id")
        keys = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begins = new.copy()
        begins[0] = bool(before) and before[0] != conv[0].as_py()  # a partition's first row may go on from the partition before
        fault = rows.column("fault").to_numpy()
        here = fault != GONE
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        # Places of turns in their run, those that are gone not counted; a new segment after every so many.
        count = np.cumsum(here) - here
        place = count - count[starts][run]
        cut = new | (here & (place % segment == 0) & (place > 0))
        seg = np.cumsum(cut) - 1
        first = np.flatnonzero(cut)
        place = count - count[first][seg]
        size = np.bincount(seg[here], minlength=len(first))
        single = np.bincount(run[first]) == 1
        whole = begins[first] & single[run[first]] & (run[first] < run[-1])
        entry = [[START] if begins[f] else [START, SYSTEM, USER, ASSISTANT] for f in first.tolist()]
        role, text = rows.column("role"), rows.column("text")
        turns = pa.table({"seg": seg[here], "i": place[here].astype(np.int32), "turn": rows.column("turn").filter(pa.array(here)), "initial": pc.utf8_slice_codeunits(role, 0, 1).filter(pa.array(here)), "fault": fault[here]})
        segs = pa.table({"seg": np.arange(len(first)), "size": size.astype(np.int32)})
        opens = pa.table({"seg": np.repeat(np.arange(len(first)), [len(e) for e in entry]), "state": pa.array([s for e in entry for s in e], pa.int32())})
        for name, data in (("turns", turns), ("segs", segs), ("opens", opens)):
            con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM data")
        walked = con.execute(_WALK).fetchall()
        counts = {r[0]: r[1:] for r in con.execute(_COUNTS).fetchall()}
        paths: list[list] = [[] for _ in first]
        for k, *path in walked:
            paths[k].append(dict(zip(("entry", "state", "cost", "audit"), path, strict=True)))
        roles, texts = role.filter(pa.array(here)).to_pylist(), text.filter(pa.array(here)).to_pylist()
        to = np.cumsum(size).tolist()
        out = {n: [] for n, _ in fields}
        out["conv_id"] = conv.take(pa.array(first))
        for k, (end, n) in enumerate(zip(to, size.tolist(), strict=True)):
            mine, said = roles[end - n : end], texts[end - n : end]
            sha = None
            if whole[k]:
                state, cost, audit = _best({p["state"]: (p["cost"], p["audit"]) for p in paths[k]})
                sha = hashlib.sha256("\n".join(replayed(START, audit, list(zip(mine, said, strict=True)))).encode()).hexdigest()
                paths[k], mine, said = [{"entry": START, "state": state, "cost": cost, "audit": audit}], None, None
            out["part"].append(part)
            out["seq"].append(seq + int(first[k]))
            out["whole"].append(bool(whole[k]))
            for c, v in zip(_COUNTED, counts.get(k, (0, 0, 0, 0, None, None, 0, None, None)), strict=True):
                out[c].append(v)
            out["paths"].append(paths[k])
            out["roles"].append(mine)
            out["texts"].append(said)
            out["sha"].append(sha)
        yield pa.RecordBatch.from_arrays([out[n] if n == "conv_id" else pa.array(out[n], t) for n, t in fields], names=[n for n, _ in fields])

    return ordered.mapInArrow(task, f"conv_id {kind.simpleString()}, {_KINDS}")


class _Conversation:
    """Folds the segments of one conversation in order; holds one string and one running hash for each state."""

    def __init__(self):
        self.ways = {START: (0, "", hashlib.sha256(), 0)}
        self.counts, self.low, self.high, self.turns, self.last, self.tail = [0, 0, 0, 0], None, None, 0, None, None

    def add(self, row: dict) -> None:
        best: dict[int, tuple] = {}
        for p in row["paths"]:
            if p["entry"] in self.ways:
                cost, audit, *_ = self.ways[p["entry"]]
                new = (cost + p["cost"], audit + p["audit"], p["entry"], p["audit"])
                if p["state"] not in best or new < best[p["state"]]:
                    best[p["state"]] = new
        turns = list(zip(row["roles"], row["texts"], strict=True))
        ways = {}
        for state, (cost, audit, entry, letters) in best.items():
            sha, n = self.ways[entry][2].copy(), self.ways[entry][3]
            for said in replayed(entry, letters, turns):
                sha.update((("\n" if n else "") + said).encode())
                n += 1
            ways[state] = (cost, audit, sha, n)
        self.ways = ways
        for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[c]
        if row["head"] is not None:
            self.counts[3] += self.tail is not None and self.tail + row["head"] not in ("su", "ua", "au")
            self.tail = row["tail"]
        if row["low"] is not None:  # turns come in order, so only the first can have been met
            self.turns += row["turns"] - (self.high == row["low"])
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]

    def end(self) -> list:
        state, cost, audit = _best({s: way[:2] for s, way in self.ways.items()})
        sha, n = self.ways[state][2:]
        for said in replayed(state, closed(state), []):
            sha.update((("\n" if n else "") + said).encode())
            n += 1
        return [0 if self.low is None else self.high - self.low + 1 - self.turns, *self.counts, cost, audit, sha.hexdigest()]


def repaired(turns: DataFrame, segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``turns`` (the columns of ``damaged``).

    Turns are taken by number, nulls first, and turns of one number by role, text and row.  Null roles and texts count
    as one space; rows with a null conv_id are one conversation; a role that begins with none of s, u, a can't be kept; a row
    that is repeated whole is a duplicate; a conversation whose rows are all gone has zeros, an empty string and
    the hash of an empty text; an empty table gives no rows.
    """
    parts = stored(segments(faulted(turns), segment, batch), "segments")
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = parts.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"), F.col("sha").alias("repaired_sha256"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key, done, kinds = None, None, [], None
        for rows in batches:
            kinds = pa.schema([("conv_id", rows.schema.field("conv_id").type), *[(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]])
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                if open_ is None or row["conv_id"] != key:
                    if open_ is not None:
                        done.append([key, *open_.end()])
                    open_, key = _Conversation(), row["conv_id"]
                open_.add(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds)
                done = []
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([key, *open_.end()], kinds, strict=True)], schema=kinds)

    cut = parts.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").drop("whole", "sha", "part", "seq")
    return whole.union(cut.mapInArrow(fold, f"conv_id {kind}, {_REPORT}"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation of ``conversations``, damaged by its keys' checksums, with its faults and its cheapest repair; see ``repaired`` for nulls, ties, repeats and empty tables."""
    return repaired(stored(damaged(table(spark, sf_dir, "conversations")), "damaged"))


#: CRC-32 of an ASCII string ``k``, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(k, '')]), lambda h, b: xor(h >> 8, list_reduce(list_prepend(xor(h, b) & 255, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, o: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END))), 4294967295::UBIGINT)"

SQL = rf"""
WITH RECURSIVE k AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, {_CRC} % 20 AS z FROM k),
d AS (SELECT c, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN z = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE z <> 0),
n AS (SELECT *, role[1] AS x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair FROM n),
f AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size FROM t GROUP BY c),
-- a state is the last initial; '-' is the start. e: (state, letters, state after, cost) of up to two inserts.
e AS (SELECT * FROM (VALUES ('-', '', '-', 0), ('-', 'I', 'u', 2), ('-', 'II', 'a', 4), ('s', '', 's', 0), ('s', 'I', 'u', 2), ('s', 'II', 'a', 4), ('u', '', 'u', 0), ('u', 'I', 'a', 2), ('a', '', 'a', 0), ('a', 'I', 'u', 2)) v(was, letters, state, cost)),
w AS (SELECT c, 0::BIGINT AS i, '-' AS state, 0::BIGINT AS cost, '' AS audit FROM f
      UNION ALL
      SELECT c, i, state, best.cost, best.audit FROM (
        SELECT c, i, state, min({{'cost': cost, 'audit': audit}}) AS best FROM (
          SELECT w.c, t.i, unnest([
              CASE WHEN fault NOT IN ('blank', 'duplicate') AND e.state || t.x IN ('-s', '-u', 'su', 'ua', 'au') THEN {{'state': t.x, 'cost': w.cost + e.cost + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.audit || e.letters || 'K'}} END,
              CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {{'state': CASE WHEN e.state = 'u' THEN 'a' ELSE 'u' END, 'cost': w.cost + e.cost + 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.audit || e.letters || 'R'}} END,
              {{'state': e.state, 'cost': w.cost + e.cost + 3, 'audit': w.audit || e.letters || 'D'}}], recursive := true)
          FROM w JOIN t ON t.c = w.c AND t.i = w.i + 1 JOIN e ON e.was = w.state) WHERE state IS NOT NULL GROUP BY c, i, state)),
b AS (SELECT c, min({{'cost': cost + CASE state WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END, 'audit': audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END}}) AS best FROM w JOIN f USING (c) WHERE w.i = f.size GROUP BY c),
l AS (SELECT c, unnest(string_split(best.audit, '')) AS letter, unnest(range(1, length(best.audit) + 1)) AS p FROM b WHERE best.audit <> ''),
p AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY c ORDER BY p) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY c ORDER BY p) AS e FROM l),
r AS (SELECT p.*, t.role, t.text, max(CASE WHEN p.e = 1 AND letter = 'K' AND t.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.c) AS system FROM p LEFT JOIN t ON t.c = p.c AND t.i = p.i AND letter <> 'I'),
s AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM r WHERE letter <> 'D' GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM k) LEFT JOIN f USING (c) LEFT JOIN b USING (c) LEFT JOIN s USING (c)
"""
