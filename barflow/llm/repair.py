"""Cheapest repair of conversations to ``(system? (user assistant)+)?``, by block tables in the manner of the Four Russians.

Rows are symbols: must be deleted, or one of four kinds of role with or without a cut text. What is still to pay from each of the
pattern's four states, less what is to pay from the last, takes few values at all (``Tables.vectors``), so what a block of
``BLOCK`` symbols makes of each of them is tabulated once. A conversation is read from its end by one lookup a block; then its blocks are
opened one after the other, back against that direction, and every row takes the least letter among its cheapest edits. As what is to
pay is known before a letter is chosen, the letters are the least of all cheapest repairs, whatever the ties.

Rows are sorted into ranges, so a conversation of any length is as many pieces as it has partitions: a piece as a whole maps the
vector behind it to the one before it, and these maps are chained first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barflow.llm.session import bounded, checkpointed
from barflow.llm.sql import crc32_of

#: Costs of the edits; a row that is cut and stays costs more. Rows in a tabulated block, bytes of text in a partition, about, and in a sent chunk.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
BLOCK, PARTITION, CHUNK = 4, 48 << 20, 4 << 20
SYMBOLS, ROLES = 9, ("user", "assistant")
#: States: nothing yet, after a system row, after a user row, after an assistant row; what a user or assistant row leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
_STEP, _KEPT = (USER, USER, ASSISTANT, USER), (SYSTEM, USER, ASSISTANT)
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


class Tables:
    """Vectors that can occur, what each symbol and each block makes of them, and the edits of a block."""

    def __init__(self, block: int = BLOCK):
        self.block, first = block, (0, 2 * INSERT, INSERT, 0)
        self.vectors, steps, self._edits = [first], [], {}
        place = {first: 0}
        for v in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                before = self.before(v, symbol)
                key = tuple(x - before[ASSISTANT] for x in before)
                if key not in place:
                    place[key] = len(self.vectors)
                    self.vectors.append(key)
                row.append((place[key], before[ASSISTANT]))
            steps.append(row)
        one = np.array(steps, np.int32)  # vector, symbol -> (vector, paid)
        self.to, self.paid = one[:, :, 0], one[:, :, 1]
        self.blocks_to, self.blocks_paid = self.to, self.paid
        for _ in range(block - 1):  # a symbol in front of each shorter block
            to, paid = self.to[self.blocks_to], self.blocks_paid[:, :, None] + self.paid[self.blocks_to]
            self.blocks_to, self.blocks_paid = (x.transpose(0, 2, 1).reshape(len(x), -1) for x in (to, paid))
        self.one_to, self.one_paid, self.many_to, self.many_paid = (x.tolist() for x in (self.to, self.paid, self.blocks_to, self.blocks_paid))

    @staticmethod
    def options(after: tuple, symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Edits of a row in the order of their letters: (letter, what is to pay with it, next state)."""
        out = [("D", DELETE + after[state], state)]
        if symbol:
            kind, cut = divmod(symbol - 1, 2)  # system, user, assistant, other
            if (state == START, _STEP[state] == USER, state == USER, False)[kind]:
                out.append(("K", CUT * cut + after[_KEPT[kind]], _KEPT[kind]))
            out.append(("R", REROLE + CUT * cut + after[_STEP[state]], _STEP[state]))
        return out

    def before(self, after: tuple, symbol: int) -> list[int]:
        """What is to pay from each state before a row, rows inserted in front of it included."""
        out = [min(cost for _, cost, _ in self.options(after, symbol, s)) for s in range(4)]
        out[USER], out[ASSISTANT] = min(out[USER], INSERT + out[ASSISTANT]), min(out[ASSISTANT], INSERT + out[USER])
        return [min(out[s], INSERT + out[USER]) for s in (START, SYSTEM)] + out[USER:]

    def edits(self, vector: int, symbols: tuple, state: int) -> tuple[tuple[str, ...], int]:
        """The letters of each of a block's rows, insertions in front of it first, and the state behind it."""
        key = (vector, symbols, state)
        if key not in self._edits:
            behind = [vector]
            for symbol in symbols[:0:-1]:
                behind.append(self.one_to[behind[-1]][symbol])
            letters = []
            for symbol, v in zip(symbols, reversed(behind)):
                after, row = self.vectors[v], ""
                before = self.before(after, symbol)
                while True:
                    options = [*self.options(after, symbol, state), ("I", INSERT + before[_STEP[state]], None)]
                    letter, _, to = min(x for x in options if x[1] == before[state])
                    row += letter
                    if letter != "I":
                        state = to
                        break
                    state = _STEP[state]
                letters.append(row)
            self._edits[key] = tuple(letters), state
        return self._edits[key]

    def cut(self, symbols: list[int]) -> tuple[list[tuple], list[tuple]]:
        """The symbols that make up no block, one by one, and the blocks behind them."""
        odd = len(symbols) % self.block
        return [(x,) for x in symbols[:odd]], [tuple(symbols[i : i + self.block]) for i in range(odd, len(symbols), self.block)]

    def code(self, block: tuple) -> int:
        return functools.reduce(lambda a, x: a * SYMBOLS + x, block)

    def behind(self, symbols: list[int], vector: int) -> tuple[list[tuple], list[int], int, int]:
        """The parts of the symbols, the vector behind each, the one before them all, and what is paid for the last state."""
        single, blocks = self.cut(symbols)
        at, paid = [], 0
        for block in reversed(blocks):
            at.append(vector)
            code = self.code(block)
            vector, paid = self.many_to[vector][code], paid + self.many_paid[vector][code]
        for (symbol,) in reversed(single):
            at.append(vector)
            vector, paid = self.one_to[vector][symbol], paid + self.one_paid[vector][symbol]
        return single + blocks, at[::-1], vector, paid

    def mapped(self, symbols: list[int]) -> list[int]:
        """What the symbols make of every vector."""
        single, blocks = self.cut(symbols)
        out = np.arange(len(self.vectors))
        for block in reversed(blocks):
            out = self.blocks_to[out, self.code(block)]
        for (symbol,) in reversed(single):
            out = self.to[out, symbol]
        return out.tolist()

    def letters(self, parts: list[tuple], at: list[int], state: int) -> tuple[list[str], int]:
        """The edits of each row of the parts from a state on, and the state behind them."""
        out: list[str] = []
        for part, vector in zip(parts, at):
            found, state = self.edits(vector, part, state)
            out += found
        return out, state


@functools.lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


ENDING = ("", "II", "I", "")  # insertions behind the last row, by state


class Repaired:
    """The digest of a repaired conversation, row by row."""

    def __init__(self):
        self.digest, self.any, self.state = hashlib.sha256(), False, START

    def edit(self, letters: str, role: str, text: str) -> None:
        for x in letters:
            if x == "D":
                continue
            self.state = _KEPT["sua".index(role[0])] if x == "K" else _STEP[self.state]
            line = f"{role if x == 'K' else ROLES[self.state - USER]}:{'' if x == 'I' else text}"
            self.digest.update(("\n" * self.any + line).encode("utf-8", "surrogatepass"))
            self.any = True


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): equal rows once, with their number. A null role or text is one space."""
    if "n" not in conversations.columns:
        conversations = conversations.withColumn("n", F.lit(1))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.groupBy("conv_id", "turn", space("role"), space("text")).agg(F.sum("n").cast("long").alias("n"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def judged(rows: DataFrame) -> DataFrame:
    """``rows_of`` with a digest of the text, ``fault`` (1 blank, 2 duplicate, 3 truncated, else 0) of the first of equal rows, and its symbol.
    The others have the same fault where it is blank, and are duplicates where not."""
    trimmed = F.rtrim("text", F.lit(_SPACE))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("place", place)
    again = rows.where(trimmed != "").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = bounded(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    rows = rows.join(again, same("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(trimmed == "", 1).when(F.col("place") > F.col("first"), 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * kind + (F.col("fault") == 3).cast("int"))
    return rows.select("conv_id", "turn", "role", "text", "n", "digest", "fault", symbol.cast("int").alias("symbol"))


def ranged(rows: DataFrame, partition: int = PARTITION) -> DataFrame:
    """The rows sorted by conversation, turn (nulls first), role, the first characters of the text and its digest, in ranges of about so many
    bytes of text; written, so that the ranges stand."""
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("begin", F.substring("text", 1, 64))
    order = ["conv_id", "turn", "role", "begin", "digest"]
    return checkpointed(rows.repartitionByRange(max(least, size // partition + 1), *order).sortWithinPartitions(*order).drop("begin", "digest"))


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """(conv_id, batches) of each conversation of a sorted partition."""
    held: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        cuts = [i for i in range(len(ids)) if (ids[i] != ids[i - 1] if i else bool(held) and ids[0] != now)]
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a in cuts and held:
                yield now, held
                held = []
            if b > a:
                now = ids[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def chained(edges: list, table: Tables) -> dict[int, tuple[int, bool, bool]]:
    """By partition: the vector behind its last conversation, whether its first one began before it, and whether its last one goes on."""
    out: dict[int, tuple[int, bool, bool]] = {}
    edges = sorted(edges, key=lambda e: e["part"])
    vector, later = 0, None
    for i in range(len(edges) - 1, -1, -1):
        e = edges[i]
        goes_on = later is not None and later["first"] == e["last"]
        behind = vector if goes_on else 0
        out[e["part"]] = (behind, i > 0 and edges[i - 1]["last"] == e["first"], goes_on)
        vector, later = e["mapped"][behind if e["single"] else 0], e
    return out


RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = RESULT + ", part int, piece int, low long, high long, turns long, begin string, end string, stay array<long>, states array<int>, audits array<string>, rows array<struct<letters:array<string>,role:string,text:string>>"
_LEGAL = {"su", "ua", "au"}


def _pieces(batches: Iterator[pa.RecordBatch], part: int, known: dict, block: int) -> Iterator[dict]:
    """A row for each conversation that the partition holds whole; for others, what is needed to join their pieces."""
    table = tables(block)
    behind, began, goes_on = known[part]
    items, first = conversations_of(batches), True
    item = next(items, None)
    while item is not None:
        (conv_id, held), item = item, next(items, None)
        open_left, open_right = first and began, item is None and goes_on
        first = False
        symbols = [x for b in held for x in b.column("symbol").to_pylist()]
        parts, at, vector, paid = table.behind(symbols, behind if open_right else 0)
        row = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        turns, begin, end = [], None, None
        for b in held:
            turns += [x for x in b.column("turn").to_pylist() if x is not None]
            for fault, n, role in zip(*(b.column(c).to_pylist() for c in ("fault", "n", "role"))):
                row["blank"] += n if fault == 1 else 0
                row["duplicate"] += n if fault == 2 else n - 1 if fault != 1 else 0
                row["truncated"] += fault == 3
                row["illegal"] += n - 1 + (end is not None and end + role[:1] not in _LEGAL)
                begin, end = role[:1] if begin is None else begin, role[:1]
        low, high, distinct = (turns[0], turns[-1], 1 + sum(a != b for a, b in zip(turns, turns[1:]))) if turns else (None, None, 0)
        extras = [x - 1 for b in held for x in b.column("n").to_pylist()]
        if not open_left and not open_right:
            letters, state = table.letters(parts, at, START)
            digest, i = Repaired(), 0
            for b in held:
                for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                    digest.edit(letters[i], role, text)
                    i += 1
            digest.edit(ENDING[state], "", "")
            audit = "".join(x + "D" * n for x, n in zip(letters, extras)) + ENDING[state]
            cost = paid + table.vectors[vector][START] + DELETE * sum(extras)
            yield row | {"gaps": high - low + 1 - distinct if turns else 0, "audit": audit, "cost": cost, "repaired_sha256": digest.digest.hexdigest()}
            continue
        ways = [table.letters(parts, at, s) for s in range(4)]
        row |= {"part": part, "low": low, "high": high, "turns": distinct, "begin": begin, "end": end, "states": [s for _, s in ways]}
        row["audits"] = ["".join(x + "D" * n for x, n in zip(way, extras)) for way, _ in ways]
        row["stay"] = [sum(x > 0 and x % 2 == 0 and letters[-1] != "D" for x, letters in zip(symbols, way)) for way, _ in ways]
        piece, rows, size, i = 0, [], 0, 0
        for b in held:
            for role, text, symbol in zip(*(b.column(c).to_pylist() for c in ("role", "text", "symbol"))):
                rows.append({"letters": [way[i] for way, _ in ways], "role": role, "text": text if symbol else ""})
                size, i = size + len(text), i + 1
                if size > CHUNK:
                    yield row | {"piece": piece, "rows": rows}
                    row, piece, rows, size = {"conv_id": conv_id, "part": part}, piece + 1, [], 0
        yield row | {"piece": piece, "rows": rows}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Conversations of several pieces, read in order: one chunk of rows is held at a time."""
    for conv_id, held in conversations_of(batches):
        out = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        digest, state, entry, low, high, turns, last, audit = Repaired(), START, START, None, None, 0, None, []
        for x in (x for b in held for x in b.to_pylist()):
            if x["piece"] == 0:
                entry, state = state, x["states"][state]
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    out[c] += x[c]
                out["illegal"] += last is not None and last + x["begin"] not in _LEGAL
                last = x["end"]
                turns += x["turns"] - (high is not None and x["low"] == high)
                low, high = (x["low"] if low is None else low), (high if x["high"] is None else x["high"])
                audit.append(x["audits"][entry])
                out["cost"] += CUT * x["stay"][entry]
            for r in x["rows"]:
                digest.edit(r["letters"][entry], r["role"], r["text"])
        digest.edit(ENDING[state], "", "")
        out["audit"] = "".join(audit) + ENDING[state]
        out["cost"] += DELETE * out["audit"].count("D") + INSERT * out["audit"].count("I") + REROLE * out["audit"].count("R")
        yield out | {"gaps": high - low + 1 - turns if low is not None else 0, "repaired_sha256": digest.digest.hexdigest()}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1000 + sum(len(r["text"]) for r in row.get("rows") or [])
        if size > CHUNK:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def repaired(conversations: DataFrame, block: int = BLOCK, partition: int = PARTITION) -> DataFrame:
    """A row for each conv_id of ``conversations(conv_id, turn, role, text)``, and of rows ``n`` of which stand for one where there is such a column.

    gaps: missing turns between the least and the greatest. Each row's first fault counts: blank, duplicate (role and text seen earlier) or
    truncated (the last character but white space is none of ``.!?``). illegal: neighbours whose initials are not su, ua or au. audit: the
    letters of the cheapest edits (Keep, Rerole, Delete, Insert), the least by ASCII among ties; cost: their sum. repaired_sha256: of
    ``role:text`` of what they leave, joined by newlines. Null roles and texts are one space, null ids a conversation, null turns come first; rows
    of one turn follow in the order of role, the text's first 64 characters and its SHA-256. Very long texts and conversations are read
    whole, the latter in pieces; what joins its pieces is one short row a partition. A digest is a chain by its nature: the rows of one
    conversation of several pieces pass one task, a chunk at a time. Other columns are not read; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = ranged(judged(rows_of(conversations)), partition)
    id_type = dict(rows.dtypes)["conv_id"]
    result, pieces = RESULT.format(id=id_type), PIECE.format(id=id_type)
    arrow = {x: to_arrow_schema(StructType.fromDDL(x)) for x in (result, pieces)}

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, symbols, last, single = None, [], None, True
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            begin = begin or ([ids[0]] if ids else None)
            if ids and single:
                stop = next((i for i, x in enumerate(ids) if x != begin[0]), len(ids))
                symbols += batch.column("symbol").to_pylist()[:stop]
                single = stop == len(ids)
            last = [ids[-1]] if ids else last
        if begin:
            found = {"part": [TaskContext.get().partitionId()], "first": begin, "last": last, "single": [single], "mapped": [tables(block).mapped(symbols)]}
            kind = arrow[result].field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array(found[k], t) for k, t in (("part", pa.int32()), ("first", kind), ("last", kind), ("single", pa.bool_()), ("mapped", pa.list_(pa.int32())))], list(found))

    known = chained(rows.select("conv_id", "symbol").mapInArrow(edges, f"part int, first {id_type}, last {id_type}, single boolean, mapped array<int>").collect(), tables(block))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part in known:
            yield from _batches(_pieces(batches, part, known, block), arrow[pieces])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_joined(batches), arrow[result])

    found = checkpointed(rows.mapInArrow(whole, pieces))
    names = [x.name for x in arrow[result]]
    open_pieces = found.where("part is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return found.where("part is null").select(names).unionByName(open_pieces.mapInArrow(joined, result))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by the crc32 of ``conv_id:turn``, modulo 20: rows lost, emptied, without full stops, twice, or by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "utf-8")) % 20).alias("damage"))
    new = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("damage <> 0").select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("n"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``, damaged; conversations that lost all rows have zeros, no edits and the digest of nothing."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repaired(damaged(table)).withColumnRenamed("conv_id", "c")
    out = table.select("conv_id").distinct().join(found, same("conv_id", "c"), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {
    "op13_conversation_repair": rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_of("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS damage
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[:64], sha256(text)) AS i, role[:1] AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND seen > 1 AS duplicate, trimmed <> '' AND seen = 1 AND NOT regexp_matches(trimmed, '[.!?]$') AS truncated FROM e),
s AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
w AS (  -- the cheapest edits that lead to each state, least letters first
  SELECT conv_id, n, 0 AS i, {{'c': 0, 'a': ''}} AS e, {{'c': 1000000000, 'a': ''}} AS s, {{'c': 1000000000, 'a': ''}} AS u, {{'c': 1000000000, 'a': ''}} AS a FROM s
  UNION ALL
  SELECT conv_id, n, i, {{'c': e.c + del, 'a': e.a || 'D'}},
         list_min([{{'c': s.c + del, 'a': s.a || 'D'}}, {{'c': e.c + CASE WHEN initial = 's' THEN stay ELSE 1000000000 END, 'a': e.a || 'K'}}]),
         list_min([{{'c': u1.c + del, 'a': u1.a || 'D'}}, {{'c': from_u.c + CASE WHEN initial = 'u' THEN stay ELSE 2 + stay END, 'a': from_u.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END}}]),
         list_min([{{'c': a1.c + del, 'a': a1.a || 'D'}}, {{'c': u1.c + CASE WHEN initial = 'a' THEN stay ELSE 2 + stay END, 'a': u1.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END}}])
  FROM (
    SELECT *, list_min([e, s, a1]) AS from_u FROM (
      SELECT *, list_min([a, {{'c': u1.c + 2, 'a': u1.a || 'I'}}]) AS a1 FROM (
        SELECT w.conv_id, w.n, f.i, f.initial, w.e, w.s, w.a, 3 AS del, CASE WHEN f.blank OR f.duplicate THEN 1000000000 WHEN f.truncated THEN 1 ELSE 0 END AS stay,
               list_min([w.u, {{'c': w.e.c + 2, 'a': w.e.a || 'I'}}, {{'c': w.s.c + 2, 'a': w.s.a || 'I'}}, {{'c': w.a.c + 2, 'a': w.a.a || 'I'}}]) AS u1
        FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))),
b AS (
  SELECT conv_id, list_min([e, a, {{'c': u.c + 2, 'a': u.a || 'I'}}, {{'c': e.c + 4, 'a': e.a || 'II'}}, {{'c': s.c + 4, 'a': s.a || 'II'}}]) AS best FROM w WHERE i = n),
k AS (SELECT conv_id, best.a AS audit, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS j FROM b WHERE best.a <> ''),
q AS (SELECT *, count_if(edit <> 'I') OVER v AS i, count_if(edit <> 'D') OVER v AS nth FROM k WINDOW v AS (PARTITION BY conv_id ORDER BY j)),
r AS (
  SELECT q.conv_id, q.j, q.edit, q.nth, f.role, f.text,
         max(CASE WHEN q.nth = 1 AND q.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS system
  FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i AND q.edit <> 'I'),
h AS (
  SELECT conv_id, sha256(string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY j)) AS digest
  FROM r WHERE edit <> 'D' GROUP BY conv_id)
SELECT t.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
       coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(b.best.c, 0)::BIGINT AS cost,
       coalesce(b.best.a, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS t
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id"""
}
