"""Conversation repair against exhaustive search and a plain recursion over audits as strings."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import repair
from tidemark.llm.repair import BLANK, DUPLICATE, SOUND, TRUNCATED, Costs

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)
WHOLE = re.compile(r"(s?(ua)+)?")


def exhaustive(rows, costs):
    """Every way to edit and to insert up to two turns in each place, judged by the pattern."""
    best = None
    inserts = [()] + [(x,) for x in "ua"] + list(itertools.product("ua", repeat=2))
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("KDua", repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for i in range(len(rows) + 1):
                cost, audit, roles = cost + costs.insert * len(gaps[i]), audit + "I" * len(gaps[i]), roles + "".join(gaps[i])
                if i == len(rows):
                    break
                (initial, fault), edit = rows[i], edits[i]
                if edit == "D":
                    cost, audit = cost + costs.delete, audit + "D"
                    continue
                if fault in (BLANK, DUPLICATE):
                    break
                cost += costs.truncated if fault == TRUNCATED else 0
                cost, audit, roles = (cost + costs.keep, audit + "K", roles + (initial or "x")) if edit == "K" else (cost + costs.rerole, audit + "R", roles + edit)
            else:
                continue
            if i == len(rows) and WHOLE.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def recursion(rows, costs):
    """The same by (cost, audit) pairs from the end; strings compare as the contract says."""

    @lru_cache(maxsize=None)
    def go(i, last, gap):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, ""))
        if gap < 2:
            c, a = go(i, "a" if last == "u" else "u", gap + 1)
            ways.append((c + costs.insert, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = go(i + 1, last, 0)
            ways.append((c + costs.delete, "D" + a))
            if fault not in (BLANK, DUPLICATE):
                more = costs.truncated if fault == TRUNCATED else 0
                if (last, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    c, a = go(i + 1, initial, 0)
                    ways.append((c + costs.keep + more, "K" + a))
                c, a = go(i + 1, "a" if last == "u" else "u", 0)
                ways.append((c + costs.rerole + more, "R" + a))
        return min(ways, default=(10**9, ""))

    return go(0, "", 0)


def solved(rows, costs, piece):
    parts = [tuple(rows[i : i + piece]) for i in range(0, len(rows), piece)]
    return repair.solve([(len(p), list(repair.piece_weights(p, costs))) for p in parts], costs)


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(keep=1, rerole=1, delete=1, insert=1, truncated=0), Costs(rerole=0, delete=3, insert=2)])
def test_least_weights_are_the_cheapest_edits(costs):
    rng = random.Random(5)
    draw = lambda n: tuple((rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.choice([SOUND] * 5 + [BLANK, DUPLICATE, TRUNCATED])) for _ in range(n))
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2):
        rows = draw(n)
        assert exhaustive(rows, costs) == recursion(rows, costs) == solved(rows, costs, 64)
    for n in (3, 5, 8, 13, 21, 40):
        for _ in range(8):
            rows = draw(n)
            wanted = recursion(rows, costs)
            assert {solved(rows, costs, piece) for piece in (1, 2, 7, 64)} == {wanted}


def test_long_conversation_of_many_pieces():
    rng = random.Random(6)
    rows = tuple((rng.choice("suax"), rng.choice([SOUND] * 6 + [BLANK, TRUNCATED])) for _ in range(450))
    assert solved(rows, Costs(), 64) == recursion(rows, Costs())


def brute(rows, damaged=True):
    """``{conv: row}`` by the letter of the contract."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20 if damaged else 19
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for turn, role, text in kept:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = BLANK if not body else DUPLICATE if (role, text) in seen else TRUNCATED if body[-1] not in ".!?" else SOUND
            seen.add((role, text))
            marked.append((role[:1], fault))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit = recursion(tuple(marked), Costs())
        fixed, last, at = [], "", 0
        for letter in audit:
            target = "assistant" if last == "u" else "user"
            if letter == "I":
                fixed.append(target + ":")
            else:
                _, role, text = kept[at]
                at += 1
                if letter == "D":
                    continue
                target = role if letter == "K" else target
                fixed.append(f"{target}:{text}")
            last = target[0]
        count = lambda f: sum(x == f for _, x in marked)  # noqa: B023, E731
        out[conv] = (gaps, count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def conversations(seed, convs, turns):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "Well", "who?", "", " \t", "a b.", "ok.  ", "é.", None, "x\u000b", "x ."]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, turns)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant", "system", None, "", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
                rows.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(words) if rng.random() < 0.4 else f"Turn {rng.random()}."))
    return rows


def run(spark, rows, damaged=True, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", copies int").repartition(3)
    if damaged:
        df = repair.damage(df.drop("copies"))
    found = repair.repair(df, **kw).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


def test_rows_equal_the_contract(spark):
    rows = conversations(7, 60, 12)
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "So."), (500, None, None, None), (501, None, "user", "A."), (501, None, "assistant", "B.")]
    rows += [(600, 3, "user", "Same."), (600, 3, "user", "Same."), (600, 3, "user", "Same.")] + [(601, t, "user", "Again.") for t in range(150)]
    rows += [(602, 1 << 60, "user", "Far."), (602, -5, "assistant", "lorem ipsum " * 50_000)]
    rows += [(603 + i, 0, "user", "Only.") for i in range(40)]  # some of them lose their only row
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, piece=2) == brute(rows)


def test_long_conversation_and_copies(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{t}{rng.choice(['.', '.', '?', ''])}") for t in range(400)]
    df = spark.createDataFrame([(*r, 1 + (r[1] % 97 == 0) * 3) for r in rows], SCHEMA + ", copies int").repartition(5)
    found = repair.repair(df).collect()[0]
    many = [r for r in rows for _ in range(1 + (r[1] % 97 == 0) * 3)]
    assert tuple(found)[1:] == brute(many, damaged=False)[1]


def test_repaired_turns_and_edge_tables(spark):
    df = spark.createDataFrame([(1, 0, "tool", "A.", 1, "x"), (1, 1, "user", "B.", 1, "y"), (1, 2, "user", " ", 1, "z")], SCHEMA + ", copies int, audit string")
    rows = repair.judged(df)
    turns = repair.repaired_turns(rows, repair.plan(rows)).orderBy("position").collect()
    assert [tuple(t) for t in turns] == [(1, 0, "user", "A."), (1, 1, "assistant", "B.")]
    assert repair.repair(df).collect()[0].audit == "RRD"
    assert run(spark, []) == {}
    assert repair.repair(repair.damage(spark.createDataFrame([(9, 1, "user", "x", "extra")], SCHEMA + ", fault string"))).count() == 1
    with pytest.raises(ValueError):
        Costs(insert=0)


def test_sql_equals_the_contract():
    rows = conversations(9, 40, 9) + [(None, 0, "user", "Hi."), (None, None, "assistant", "So."), (500, None, None, None), (501, None, "user", "A.")]
    rows += [(600, 3, "user", "Same."), (600, 3, "user", "Same.")] + [(603 + i, 0, "user", "Only.") for i in range(40)]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
    con = duckdb.connect()
    con.register("conversations", pa.table(columns, ["conv_id", "turn", "role", "text"]))
    assert {r[0]: tuple(r)[1:] for r in con.execute(repair.SQL).fetchall()} == brute(rows)
