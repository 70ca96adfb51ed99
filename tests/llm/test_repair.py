"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from barflow.llm import repair as R

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def search(rows):
    """(cost, audit, repaired lines) by uniform-cost search: among the cheapest, the least letters."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "E", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "EA":
            return cost, audit, lines, faults
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in NEXT[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state][initial], (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] not in ("b", "d"):
                cut = faults[i] == "t"
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, NEXT[state][role[:1]], (*lines, f"{role}:{text}")))
                for initial, new in (("u", "user"), ("a", "assistant")):
                    if initial in NEXT[state]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, NEXT[state][initial], (*lines, f"{new}:{text}")))


def expected(conv_id, rows):
    rows = ordered(rows)
    cost, audit, lines, faults = search(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv_id, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(rng, n):
    texts = ["Yes.", "No", "", " \n", "Why? ", "é!", "x" * 70 + "1.", "x" * 70 + "2", None]
    return [(rng.choice([i, i, i, None, i + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None]), rng.choice(texts + [f"{i}.", f"{i}."] * 6)) for i in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string, audit int, part string, n_turns int"


@pytest.mark.parametrize("block,partition", [(1, 1 << 20), (3, 700), (4, 1 << 20)])
def test_repair_equals_search(spark, block, partition):
    rng = random.Random(block)
    talks = {i: made(rng, rng.choice([1, 2, 3, 5, 9, 14])) for i in range(150)} | {None: made(rng, 6), 999: made(rng, 150), 1000: [(1, "user", "Hi.")] * 40 + made(rng, 9)}
    rows = [(c, *r, 1, "p", 2) for c, talk in talks.items() for r in talk]
    rng.shuffle(rows)
    got = R.repaired(spark.createDataFrame(rows, SCHEMA), block, partition).collect()
    assert {tuple(r) for r in got} == {expected(c, talk) for c, talk in talks.items()} and len(got) == len(talks)


def test_one_conversation_of_all_partitions(spark):
    rng = random.Random(5)
    talk = [(i, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"{i}.", f"{i}", "Yes."])) for i in range(3000)]
    (got,) = R.repaired(spark.createDataFrame([(7, *r, 1, "p", 2) for r in talk], SCHEMA), 4, 20_000).collect()
    assert tuple(got) == expected(7, talk)


def test_blocks_equal_single_steps():
    rng, one = random.Random(1), R.Tables(1)
    for block in (2, 3, 4):
        table = R.Tables(block)
        for _ in range(200):
            symbols, v = [rng.randrange(9) for _ in range(rng.randrange(30))], rng.randrange(len(table.vectors))
            assert table.behind(symbols, v)[2:] == one.behind(symbols, v)[2:] and table.mapped(symbols) == one.mapped(symbols)
            s = rng.randrange(4)
            assert table.letters(*table.behind(symbols, v)[:2], s) == one.letters(*one.behind(symbols, v)[:2], s)


def damaged(conv_id, turn, role, text):
    fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
    return [] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))


def test_query_with_nulls_ties_and_lost_conversations(spark, tmp_path):
    rng = random.Random(9)
    talks = {i: made(rng, rng.choice([1, 1, 2, 7])) for i in range(200)} | {None: made(rng, 5)}
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = {c: [x for r in talk for x in damaged(c, *r)] for c, talk in talks.items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {expected(c, talk) if talk else (c, *nothing) for c, talk in left.items()}
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert any(not talk for talk in left.values())
    assert {tuple(r) for r in R.op13_conversation_repair(spark, str(tmp_path)).select(names).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert set(con.execute(f"SELECT {', '.join(names)} FROM ({R.ORACLES['op13_conversation_repair']})").fetchall()) == want


def test_empty(spark):
    assert R.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
