"""Repair of conversation structure: the cheapest edits that give legal turns, by whole-number weights in a row-by-row graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready
from tidemark.session import stage

#: First fault of a row, in the order in which it is looked for.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of one piece of a conversation; pieces are worked out apart and joined in order.
PIECE = 64

# Initials of the edits as digits in ASCII order; 0 pads the end, so that a shorter audit comes before its extensions.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
#: Bits of a digit.
DIGIT = 3
# States of `(s?(ua)+)?`. The next inserted or reroled turn is the assistant's after a user, else the user's.
START, AFTER_SYSTEM, AFTER_USER, COMPLETE = STATES = range(4)
ENDS = (START, COMPLETE)
KEEPS = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (COMPLETE, "u"): AFTER_USER, (AFTER_USER, "a"): COMPLETE}
TURN_OF = ("user", "user", "assistant", "user")
NEXT = (AFTER_USER, AFTER_USER, COMPLETE, AFTER_USER)


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if self.insert <= 0 or min(self.keep, self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("insertions must cost something, other edits may not cost less than nothing")


# --- weights

# A weight is one whole number: cost × 8^width, plus the audit as octal digits from the left of `width` places, zeros behind. Letters come
# before those already weighed, so a letter goes to the first place and the audit so far moves one place right. The least number is the
# cheapest way with the least audit. The graph runs back from the end: of two audits from one place on, the lesser one stays the
# lesser behind any same beginning, which does not hold for beginnings of different length.


def _before(weight: int, digit: int, cost: int, width: int) -> int:
    low = weight & ((1 << DIGIT * width) - 1)
    return weight - low + (cost << DIGIT * width) + (digit << DIGIT * (width - 1)) + (low >> DIGIT)


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def _inserted(now: list[int | None], width: int, costs: Costs) -> list[int | None]:
    """Weights with any insertions in front. As each costs something, no state is met twice: two at most."""
    ahead = now
    for _ in range(2):
        ahead = [
            _least(now[q], None if ahead[NEXT[q]] is None else _before(ahead[NEXT[q]], INSERT, costs.insert, width)) for q in STATES
        ]
    return ahead


def _row(after: list[int | None], initial: str, fault: int, width: int, costs: Costs) -> list[int | None]:
    """Weights in front of a row, from those behind it."""
    out = []
    more = costs.truncated if fault == TRUNCATED else 0
    for q in STATES:
        ways = [] if after[q] is None else [_before(after[q], DELETE, costs.delete, width)]
        if fault not in (BLANK, DUPLICATE):
            kept = KEEPS.get((q, initial))
            if kept is not None and after[kept] is not None:
                ways.append(_before(after[kept], KEEP, costs.keep + more, width))
            if after[NEXT[q]] is not None:
                ways.append(_before(after[NEXT[q]], REROLE, costs.rerole + more, width))
        out.append(_least(*ways))
    return _inserted(out, width, costs)


@lru_cache(maxsize=8192)
def piece_weights(rows: tuple[tuple[str, int], ...], costs: Costs) -> tuple[int | None, ...]:
    """Least weight from every state in front of the rows to every state behind them (row-major), in ``3 × len(rows)`` places.

    Insertions belong to the row they precede, so every way ends with the edit of the last row and none is the beginning of another.
    """
    width = 3 * len(rows)
    columns = []
    for end in STATES:
        now: list[int | None] = [0 if q == end else None for q in STATES]
        for initial, fault in reversed(rows):
            now = _row(now, initial, fault, width, costs)
        columns.append(now)
    return tuple(columns[end][q] for q in STATES for end in STATES)


def _digits(low: int, width: int) -> int:
    """Letters of an audit: places up to the last one that is not zero."""
    return width - ((low & -low).bit_length() - 1) // DIGIT if low else 0


def solve(pieces: list[tuple[int, list[int | None]]], costs: Costs) -> tuple[int, str]:
    """Cost and audit of a conversation from ``(rows, weights)`` of its pieces in order."""
    width = 3 * sum(rows for rows, _ in pieces) + 2
    shift = DIGIT * width
    now = _inserted([0 if q in ENDS else None for q in STATES], width, costs)
    for rows, weights in reversed(pieces):
        own = 3 * rows
        ahead = []
        for q in STATES:
            ways = []
            for end in STATES:
                here, behind = weights[q * len(STATES) + end], now[end]
                if here is not None and behind is not None:
                    low, rest = here & ((1 << DIGIT * own) - 1), behind & ((1 << shift) - 1)
                    cost = (here >> DIGIT * own) + (behind >> shift)
                    ways.append((cost << shift) + (low << DIGIT * (width - own)) + (rest >> DIGIT * _digits(low, own)))
            ahead.append(_least(*ways))
        now = ahead
    best = now[START]
    low = best & ((1 << shift) - 1)
    audit = f"{low:o}".zfill(width)[: _digits(low, width)]
    return best >> shift, "".join(LETTERS[int(d)] for d in audit)


# --- rows


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20; null values count as one space.

    0 drops the row (``copies`` 0, so that the conversation is still known), 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it (``copies`` 2), 4 gives it to the user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    role = F.when(fault == 0, F.lit("")).when(fault == 4, F.lit("user")).otherwise(space("role"))
    text = F.when(fault.isin(0, 1), F.lit("")).when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


#: Order of rows; rows of one turn go by role and by md5 of the text.
ORDER = ("conv_id", "turn", "role", "digest")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n`` and their ``fault`` as far as one row shows it: blank, truncated or none.

    Equal rows of a turn are summed before they are shuffled.
    """
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(SOUND)
    summed = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    return stage(summed.withColumns({"digest": F.md5("text"), "fault": fault}), "turns")


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """Rows that are there, without their texts, and the first fault of the first copy: a duplicate has its role and text at an earlier turn."""
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    slim = rows.filter("n > 0").select("conv_id", "turn", "role", "digest", "n", "fault")
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first")).select(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"
    )
    joined = slim.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    fault = F.when((F.col("fault") != BLANK) & (place > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return joined.withColumn("fault", fault).drop("_c", "_r", "_d", "first")


PIECES = (
    "conv_id {kind}, part int, piece long, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, weights array<binary>"
)
LEGAL = ("su", "ua", "au")


class _Piece:
    """Counts of a run of rows of one conversation, and the rows themselves until they are weighed."""

    def __init__(self, conv):
        self.conv, self.rows, self.counts = conv, [], [0, 0, 0, 0]
        self.illegal, self.low, self.high, self.turns = 0, None, None, 0

    def add(self, turn, initial: str, fault: int) -> None:
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.counts[fault] += 1
        self.rows.append((initial, fault))

    def row(self, part: int, number: int, costs: Costs) -> tuple:
        weights = [None if w is None else w.to_bytes(-(-w.bit_length() // 8) or 1, "big") for w in piece_weights(tuple(self.rows), costs)]
        return (
            self.conv, part, number, len(self.rows), *self.counts[BLANK:], self.illegal, self.rows[0][0], self.rows[-1][0],
            self.low, self.high, self.turns, weights,
        )


def _weigh(costs: Costs, schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now = TaskContext.get().partitionId(), 0, None
        done: list[tuple] = []
        for batch in batches:
            for conv, turn, initial, fault, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for copy in range(n):
                    if now is not None and (now.conv != conv or len(now.rows) == most):
                        done.append(now.row(part, number, costs))
                        number, now = number + 1, None
                    now = now or _Piece(conv)
                    now.add(turn, initial, fault if copy == 0 or fault == BLANK else DUPLICATE)
                    if len(done) >= 1000:
                        yield _batch(done, schema)
                        done = []
        if now is not None:
            done.append(now.row(part, number, costs))
        if done:
            yield _batch(done, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of each conversation of a sorted partition, streamed; the first column is the conversation."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    row = next(rows, None)
    while row is not None:
        conv, box = row[0], [row]

        def run(box=box, conv=conv):
            while box[0] is not None and box[0][0] == conv:
                yield box[0]
                box[0] = next(rows, None)

        own = run()
        yield conv, own
        for _ in own:  # what the reader left
            pass
        row = box[0]


def _solve_all(costs: Costs, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, rows in _runs(batches):
            pieces, counts, illegal, turns, low, high, last = [], [0, 0, 0], 0, 0, None, None, None
            for _, _, _, size, blank, duplicate, truncated, wrong, first, end, lo, hi, own, weights in rows:
                illegal += wrong + (last is not None and last + first not in LEGAL)
                if lo is not None:
                    turns += own - (lo == high)
                    low, high = lo if low is None else low, hi
                counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated), strict=True)]
                pieces.append((size, [None if w is None else int.from_bytes(w, "big") for w in weights]))
                last = end
            cost, audit = solve(pieces, costs)
            done.append((conv, 0 if low is None else high - low + 1 - turns, *counts, illegal, cost, audit))
            if len(done) >= 500:
                yield _batch(done, schema)
                done = []
        if done:
            yield _batch(done, schema)

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "bigint": pa.int64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (p.split() for p in ddl.split(", "))])


def plan(rows: DataFrame, costs: Costs = Costs(), piece: int = PIECE) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation of ``judged`` rows that has any.

    Rows go by turn (nulls first), rows of one turn by role and by md5 of the text. They are sorted over all tasks by this order, so
    that a conversation of any length is spread. Every task weighs pieces of ``piece`` rows; the weights of a conversation, a few bytes a row, are then
    joined from its end. Its audit has a letter for every row, as its result has.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    initial = F.substring("role", 1, 1)
    dealt = _with_duplicates(rows).select("conv_id", "turn", initial.alias("initial"), "fault", "n", "role", "digest")
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault", "n")
    kind = rows.schema["conv_id"].dataType.simpleString()
    told = PIECES.format(kind=kind)
    pieces = dealt.mapInArrow(_weigh(costs, _schema(told), piece), told)
    joined = pieces.repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "piece")
    out = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return stage(joined.mapInArrow(_solve_all(costs, _schema(out)), out), "plans")


# --- edits


def edited(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """Repaired ``(role, text)`` turns from an audit and the ``(role, text, copies)`` rows it is about."""
    letters, state = iter(audit), START
    letter = next(letters, "")

    def insertions():
        nonlocal letter, state
        while letter == "I":
            yield TURN_OF[state], ""
            state, letter = NEXT[state], next(letters, "")

    for role, text, copies in rows:
        for _ in range(copies):
            yield from insertions()
            if letter == "K":
                state = KEEPS[state, role[:1]]
                yield role, text
            elif letter == "R":
                yield TURN_OF[state], text
                state = NEXT[state]
            letter = next(letters, "")
    yield from insertions()


def _streamed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan and rows of each conversation in one sorted partition: first the plan, then the rows in order."""
    texts = rows.select(
        "conv_id", F.lit(1).alias("tag"), "turn", "role", "digest", F.when(F.col("fault") != BLANK, F.col("text")).alias("text"), "n",
        *[F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in plans.columns[1:]],
    )
    heads = plans.select(
        "conv_id", F.lit(0).alias("tag"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
        F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), *plans.columns[1:],
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "tag", "turn", "role", "digest")]
    return heads.unionByName(texts).repartition(parts, "conv_id").sortWithinPartitions(*order).select("conv_id", "tag", "role", "text", "n", *plans.columns[1:])


def _read(rows: Iterator[tuple]) -> tuple[tuple, Iterator[tuple[str, str, int]]]:
    """The plan of a conversation (zeros and no edits where all rows are dropped) and its rows."""
    first = next(rows)
    head = tuple(first[5:]) if first[1] == 0 else (0, 0, 0, 0, 0, 0, "")
    body = ((role, text or "", n) for _, tag, role, text, n, *_ in rows if tag)
    return head, body


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, position, role, text`` of the repaired conversations of ``judged`` rows under their ``plan``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, position long, role string, text string"
    schema = _schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for conv, own in _runs(batches):
            head, body = _read(own)
            for position, (role, text) in enumerate(edited(head[-1], body)):
                done.append((conv, position, role, text))
                size += len(text)
                if len(done) >= 2000 or size >= 4 << 20:
                    yield _batch(done, schema)
                    done, size = [], 0
        if done:
            yield _batch(done, schema)

    return _streamed(rows, plans).mapInArrow(run, out)


def repair(rows: DataFrame, costs: Costs = Costs(), piece: int = PIECE) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, copies``: its plan and ``repaired_sha256`` of the newline-joined ``role:text`` turns.

    Null roles and texts count as one space, a null conversation is one of its own, and one whose rows are all dropped has zeros, no
    audit and the digest of nothing. Rows of one turn go by role and by md5 of the text; repeated rows are copies. Other columns are ignored. The edits
    are worked out in pieces over all tasks; the digest of a conversation is sequential, so its turns stream through one task, one at a time.
    """
    ready(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    told = judged(rows.select("conv_id", "turn", space("role"), space("text"), F.col("copies").cast("long").alias("copies")))
    plans = plan(told, costs, piece)
    kind = told.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, own in _runs(batches):
            head, body = _read(own)
            digest, between = hashlib.sha256(), b""
            for role, text in edited(head[-1], body):
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
            done.append((conv, *head, digest.hexdigest()))
            if len(done) >= 500:
                yield _batch(done, schema)
                done = []
        if done:
            yield _batch(done, schema)

    return _streamed(told, plans).mapInArrow(run, out)


def _ways(q: int) -> str:
    """Delete, keep and rerole from state ``q`` as {cost, audit}; ways that are not open cost 10^9."""
    then = f"s{NEXT[q]}"
    kept = next(((initial, s) for (p, initial), s in KEEPS.items() if p == q and initial != "s"))
    keeps = [f"CASE WHEN free AND initial = '{kept[0]}' THEN {{'c': s{kept[1]}.c + t, 'a': 'K' || s{kept[1]}.a}} ELSE none END"]
    if (q, "s") in KEEPS:
        keeps.append(f"CASE WHEN free AND initial = 's' THEN {{'c': s{AFTER_SYSTEM}.c + t, 'a': 'K' || s{AFTER_SYSTEM}.a}} ELSE none END")
    reroled = f"CASE WHEN free THEN {{'c': {then}.c + 1 + t, 'a': 'R' || {then}.a}} ELSE none END"
    return f"list_sort([{{'c': s{q}.c + 2, 'a': 'D' || s{q}.a}}, {', '.join(keeps)}, {reroled}])[1]"


_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)

#: The same in DuckDB's dialect: one step of a recursion for each row from the end, with the best way from each state as (cost, audit).
SQL = f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
raw AS (SELECT *, {_CRC} % 20 AS f FROM keyed),
dam AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE f <> 0),
ord AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open FROM dam),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM ord),
flt AS MATERIALIZED (
  SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND open AS trunc, NOT blank AND NOT again AS free,
    CASE WHEN NOT blank AND NOT again AND open THEN 5 ELSE 0 END AS t FROM seen),
dp AS (
  SELECT conv_id, count(*) AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM flt GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i - 1,
    list_sort([p0, {{'c': p2.c + 5, 'a': 'I' || p2.a}}, {{'c': p3.c + 10, 'a': 'II' || p3.a}}])[1],
    list_sort([p1, {{'c': p2.c + 5, 'a': 'I' || p2.a}}, {{'c': p3.c + 10, 'a': 'II' || p3.a}}])[1],
    list_sort([p2, {{'c': p3.c + 5, 'a': 'I' || p3.a}}])[1], list_sort([p3, {{'c': p2.c + 5, 'a': 'I' || p2.a}}])[1]
  FROM (
    SELECT conv_id, i, {', '.join(f'{_ways(q)} AS p{q}' for q in STATES)}
    FROM (SELECT d.*, r.initial, r.free, r.t, {{'c': 1000000000, 'a': ''}} AS none FROM dp d JOIN flt r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i))),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM dp WHERE i = 0),
letters AS (
  SELECT conv_id, p, audit[p] AS letter, len(replace(audit[:p], 'I', '')) AS i, len(replace(audit[:p], 'D', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
kept AS (SELECT l.*, r.role, r.initial, r.text FROM letters l LEFT JOIN flt r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
named AS (SELECT *, max(CASE WHEN letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM kept),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS said
  FROM named GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
    count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(s.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id"""
