"""Conversation structure repair by cost layers over a grammar of roles.

The initials of a conversation's roles must read ``(s?(ua)+)?``.  From the last turn
to the first, each turn has layers of bitsets: layer c holds the grammar states from
which the rest can be brought to acceptance at a cost of c or less.  Layers end where
they hold all states, which they do within a few costs, so a turn takes a handful of
4-bit sets, and equal steps are looked up instead of being repeated.  The first layer
that holds the start state is the cost; a trace through the bits, always by the least
edit that stays on a cheapest way, is the least audit.

Rows go to the tasks by conversation twice: once without texts (an initial and a fault
each), which gives costs and audits, and once with texts, sorted behind their audit,
which gives the digest of the repaired text.  Both are read as streams: what a task
holds of a conversation is one byte and a few references a turn, and its audit, which
is a single value of the result anyway.  The digest of a conversation's text can only
be taken from start to end, so a conversation is never dealt to several tasks.

Defined results: a null role or text counts as one space, a null id or turn as one
space in the damage's key; null turns come first and do not count as turns; rows of one
turn are ordered by role and the text's digest, so copies stand together; null ids form
one conversation; repeated rows count; a conversation without rows has zeros, an empty
audit and the digest of the empty text; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import table

BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a; the first and the last accept.
STATES, ALL = 4, 15
ACCEPTING = 0b1001
FINE, TRUNCATED, DOOMED = 0, 1, 2
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
LEGAL = {"su", "ua", "au"}
FOUND = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

Layers = tuple[int, ...]


def kept_role(state: int, initial: str) -> int | None:
    """The state after a turn with this initial; None where the grammar forbids it."""
    return {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))


def turned(state: int) -> int:
    """The state after the one turn of user or assistant that may follow."""
    return 3 if state == 2 else 2


def holds(layers: Layers, cost: int, state: int) -> bool:
    """Whether ``state`` is in layer ``cost``: below the first layer nothing is, beyond the last everything."""
    return cost >= len(layers) or (cost >= 0 and bool(layers[cost] >> state & 1))


@lru_cache(maxsize=1 << 16)
def step(after: Layers | None, initial: str, fault: int) -> tuple[Layers, int]:
    """(layers before a turn, their first cost less that of ``after``); ``after`` None stands for the end, before which no turn is read."""
    out: list[int] = []
    base = 0
    cut = CUT_OFF if fault == TRUNCATED else 0
    while not out or out[-1] != ALL:
        c, now = base + len(out), 0
        for q in range(STATES):
            fits = holds(tuple(out), len(out) - INSERT, turned(q)) if out else False
            if after is None:
                fits |= bool(ACCEPTING >> q & 1)
            else:
                fits |= holds(after, c - DELETE, q)
                if fault != DOOMED:
                    kept = kept_role(q, initial)
                    fits |= (kept is not None and holds(after, c - cut, kept)) or holds(after, c - REROLE - cut, turned(q))
            now |= fits << q
        if now or out:
            out.append(now)
        else:
            base += 1
    return tuple(out), base


@lru_cache(maxsize=1 << 16)
def trace(state: int, cost: int, before: Layers, first: int, after: Layers | None, initial: str, fault: int) -> tuple[str, int, int]:
    """(edits up to and with this turn, state and cost that are left) by the least edits; costs are counted from the first layer."""
    done, cut = "", CUT_OFF if fault == TRUNCATED else 0
    while True:
        if after is None:
            if cost == 0 and ACCEPTING >> state & 1:
                return done, state, 0
        elif holds(after, first + cost - DELETE, state):
            return done + "D", state, first + cost - DELETE
        if cost >= INSERT and holds(before, cost - INSERT, turned(state)):
            done, state, cost = done + "I", turned(state), cost - INSERT
            continue
        kept = kept_role(state, initial)
        if kept is not None and holds(after, first + cost - cut, kept):
            return done + "K", kept, first + cost - cut
        return done + "R", turned(state), first + cost - REROLE - cut


def cheapest(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of turns (initial, fault): the cheapest edits, the least audit among them."""
    layers, firsts = [step(None, "", FINE)[0]], [0]
    for initial, fault in reversed(turns):
        before, first = step(layers[-1], initial, fault)
        layers.append(before)
        firsts.append(first)
    state, cost = 0, next(c for c in range(len(layers[-1]) + 1) if holds(layers[-1], c, 0))
    total, audit = cost + sum(firsts), []
    for k, (initial, fault) in enumerate(turns):
        at = len(turns) - k
        edits, state, cost = trace(state, cost, layers[at], firsts[at], layers[at - 1], initial, fault)
        audit.append(edits)
    audit.append(trace(state, cost, layers[0], 0, None, "", FINE)[0])
    return total, "".join(audit)


def damaged(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, n): rows after damage; n is how often a row stands, 0 where it was dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space("turn")).cast("binary")) % 20
    told = rows.select(F.col(id_col).cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return told.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def copies() -> Column:
    return F.explode(F.array_repeat(F.lit(0), F.greatest(F.col("n"), F.lit(1)))).alias("copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, initial, fault name, gone) of damaged rows, dealt and sorted by conversation, without texts."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    light = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("digest"), last.alias("last"), (F.col("n") == 0).alias("gone"), copies()).drop("copy").repartition("conv")
    same = Window.partitionBy("conv", "role", "digest", "gone").orderBy(F.asc_nulls_first("turn"))
    told = light.withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("last") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    ordered = told.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "gone")


class Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, conv: int | None):
        self.conv, self.turns = conv, []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.first, self.last, self.distinct = 0, None, None, 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        initial = initial if initial in ("s", "u", "a") else ""
        if self.turns and self.turns[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.turns.append((initial, TRUNCATED if fault == "truncated" else DOOMED if fault else FINE))
        self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1

    def row(self) -> dict:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, (1 << 63) - 1)
        cost, audit = cheapest(self.turns)
        return {"conv": self.conv, "gaps": gaps, **{k: v for k, v in self.counts.items() if k}, "illegal": self.illegal, "cost": cost, "audit": audit}


def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of sorted rows (conv, turn, initial, fault, gone)."""
    longs = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([(c, pa.int64()) for c in longs] + [("audit", pa.string())])
    now, done = None, []
    for batch in batches:
        for conv, turn, initial, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                done += [now.row()] if now else []
                now = Conversation(conv)
            if not gone:
                now.add(turn, initial, fault)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
        done = []
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], schema=schema)


class Repaired:
    """The digest of a conversation's repaired text, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.empty = audit, 0, 0, hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = turned(self.state), self.at + 1
            self.put("assistant" if self.state == 3 else "user", "")

    def add(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept_role(self.state, role[:1])
            self.put(role, text)
        elif edit == "R":
            self.state = turned(self.state)
            self.put("assistant" if self.state == 3 else "user", text)

    def digest(self) -> str:
        self.insert()
        return self.sha.hexdigest()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(found, repaired_sha256) of each conversation; its row ``found`` comes first, then its turns in order."""
    now = found = None
    for batch in batches:
        told, done = batch.column("found"), []
        roles, texts = batch.column("role"), batch.column("text")
        for k in range(batch.num_rows):
            if told[k].is_valid:
                done += [(found, now.digest())] if now else []
                found = told[k].as_py()
                now = Repaired(found["audit"])
            else:
                now.add(roles[k].as_py(), texts[k].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], told.type), pa.array([d for _, d in done], pa.string())], names=["found", "repaired_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([found], told.type), pa.array([now.digest()], pa.string())], names=["found", "repaired_sha256"])


def repaired(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation after damage."""
    rows = damaged(conversations, id_col)
    found = faults(rows).mapInArrow(repairs, FOUND)
    heads = found.select("conv", F.struct(*found.columns).alias("found"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("digest"))
    kind = heads.schema["found"].dataType
    turns = rows.where("n > 0").select("conv", F.lit(None).cast(kind).alias("found"), "turn", "role", "text", F.sha2("text", 256).alias("digest"), copies()).drop("copy")
    ordered = heads.unionByName(turns).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.isnull("found"), F.asc_nulls_first("turn"), "role", "digest")
    out = ordered.select("found", "role", "text").mapInArrow(digests, f"found {kind.simpleString()}, repaired_sha256 string")
    return out.select(F.col("found.conv").alias("conv_id"), *(f"found.{c}" for c in found.columns if c != "conv"), "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


#: crc32 by its table, since DuckDB has none; costs, audits and repaired texts by states, turn after turn.
OP11_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS i)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keyed AS (SELECT raw.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM raw, tab),
dam AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(generate_series(1, CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM keyed WHERE kind != 0)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS c, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(right(bare, 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
go(conv_id, i, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'c': 0, 'a': '', 't': []::VARCHAR[]}, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]), {'c': 3, 'a': 'I', 't': ['user:']}, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} FROM f
  UNION ALL
  SELECT conv_id, i, s0, s1, list_min([s2, {'c': list_min([s0, s1, s3]).c + 3, 'a': list_min([s0, s1, s3]).a || 'I', 't': list_append(list_min([s0, s1, s3]).t, 'user:')}]),
    list_min([s3, {'c': list_min([s2, {'c': list_min([s0, s1, s3]).c + 3, 'a': list_min([s0, s1, s3]).a || 'I', 't': list_append(list_min([s0, s1, s3]).t, 'user:')}]).c + 3,
      'a': list_min([s2, {'c': list_min([s0, s1, s3]).c + 3, 'a': list_min([s0, s1, s3]).a || 'I', 't': list_append(list_min([s0, s1, s3]).t, 'user:')}]).a || 'I',
      't': list_append(list_min([s2, {'c': list_min([s0, s1, s3]).c + 3, 'a': list_min([s0, s1, s3]).a || 'I', 't': list_append(list_min([s0, s1, s3]).t, 'user:')}]).t, 'assistant:')}])
  FROM (SELECT go.conv_id, f.i, {'c': q0.c + 4, 'a': q0.a || 'D', 't': q0.t} AS s0,
    list_min([CASE WHEN q1 IS NOT NULL THEN {'c': q1.c + 4, 'a': q1.a || 'D', 't': q1.t} END, CASE WHEN keeps AND f.c = 's' THEN {'c': q0.c + cut, 'a': q0.a || 'K', 't': list_append(q0.t, told)} END]) AS s1,
    list_min([{'c': q2.c + 4, 'a': q2.a || 'D', 't': q2.t}, CASE WHEN keeps AND f.c = 'u' THEN {'c': open.c + cut, 'a': open.a || 'K', 't': list_append(open.t, told)} END,
      CASE WHEN keeps THEN {'c': open.c + cut + 3, 'a': open.a || 'R', 't': list_append(open.t, 'user:' || text)} END]) AS s2,
    list_min([{'c': q3.c + 4, 'a': q3.a || 'D', 't': q3.t}, CASE WHEN keeps AND f.c = 'a' THEN {'c': q2.c + cut, 'a': q2.a || 'K', 't': list_append(q2.t, told)} END,
      CASE WHEN keeps THEN {'c': q2.c + cut + 3, 'a': q2.a || 'R', 't': list_append(q2.t, 'assistant:' || text)} END]) AS s3
    FROM (SELECT *, list_min([q0, q1, q3]) AS open FROM go) go JOIN (SELECT *, fault IN ('', 'truncated') AS keeps, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut, role || ':' || text AS told FROM f) f
      ON f.conv_id IS NOT DISTINCT FROM go.conv_id AND f.i = go.i + 1)),
ended AS (SELECT go.conv_id, stats.* EXCLUDE (conv_id, n), list_min([q0, q3]) AS best FROM go JOIN stats ON go.conv_id IS NOT DISTINCT FROM stats.conv_id AND go.i = stats.n)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN ended ON k.conv_id IS NOT DISTINCT FROM ended.conv_id
"""
