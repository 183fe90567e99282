"""Repair of conversation structure by Four-Russians block tables.

A conversation's rows, each reduced to one symbol, are to become a sequence whose roles read `(s?(ua)+)?`. What is left to
pay from a place in the rows on, for each of the four states of that pattern, is a vector of costs. Less its least entry it is one of
some dozens of vectors, so a table holds, for each such vector and every block of BLOCK symbols, the vector before the block and what
the block adds to it. Conversations are walked backwards a block at a time by look-up, all of a batch in step; then
forwards, where a block's inner vectors are expanded from the one behind it and at each row the least letter among the cheapest edits is taken.

Spark puts the rows in order by ranges of (conversation, turn, role, text), so that a long conversation is dealt to many
tasks; faults are told by aggregates with partial sums. Only a byte a row meets by conversation for the repair, and
the hash, which has to run over a conversation's whole repaired text, is taken in a stream of sorted rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, modest_batches
from .textbytes import text_bytes

KEEP, REROLE, DELETE, INSERT, UNTIDY = 0, 2, 3, 2, 1
BLOCK = 4
#: States of the pattern: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
STATE = {"user": USER, "assistant": ASSISTANT}
#: A row's byte: its role's initial (s, u, a, another) and its fault, 4 to each.
INITIALS, FAULTS = "sua", ["", "truncated", "duplicate", "blank"]
#: Symbols: 0 to 7 are initial and whether the row is truncated, 8 must go, 9 stands for no row.
GONE, NONE = 8, 9
SYMBOL = np.array([i + 4 * f if f < 2 else GONE for f in range(4) for i in range(4)], np.int64)
SPACES = r"[\x20\x09-\x0D]"


def moves(state: int, symbol: int) -> list[tuple[int, str, str | None, int]]:
    """Edits of a row in a state: (cost, letter, role that it has then, state after), by letter."""
    if symbol == GONE:
        return [(DELETE, "D", None, state)]
    initial, extra = symbol % 4, UNTIDY * (symbol >= 4)
    out: list[tuple[int, str, str | None, int]] = [(DELETE, "D", None, state)]
    if initial == 0 and state == EMPTY:
        out.append((KEEP + extra, "K", None, SYSTEM))
    elif initial in (1, 2) and STATE[NEXT[state]] == (USER, ASSISTANT)[initial - 1]:
        out.append((KEEP + extra, "K", None, STATE[NEXT[state]]))
    return [*out, (REROLE + extra, "R", NEXT[state], STATE[NEXT[state]])]


def closed(costs: tuple[float, ...]) -> tuple[float, ...]:
    """Costs to go, where messages may be inserted first."""
    c = list(costs)
    for _ in range(3):
        for q in range(4):
            c[q] = min(c[q], INSERT + c[STATE[NEXT[q]]])
    return tuple(c)


END = closed((0, float("inf"), float("inf"), 0))


def before(costs: tuple[float, ...], symbol: int) -> tuple[float, ...]:
    """Costs to go before a row, given those behind it."""
    return costs if symbol == NONE else closed(tuple(min(c + costs[q2] for c, _, _, q2 in moves(q, symbol)) for q in range(4)))


class Tables:
    """vectors: normalised costs to go; one, one_add: the vector before a symbol, and what is added; block, block_add: the
    same for BLOCK symbols; step, to: the edits of a row by (vector behind it, symbol, state), and the state after; finish: the
    edits after the last row, by state. Edits are numbers into `edits`: (roles inserted first, letter, role or None)."""

    def __init__(self) -> None:
        known: dict[tuple[float, ...], int] = {}
        normal = lambda c: tuple(x - min(c) for x in c)
        queue = [normal(END)]
        known[queue[0]] = 0
        for v in queue:
            for s in range(NONE + 1):
                b = normal(before(v, s))
                if b not in known:
                    known[b] = len(known)
                    queue.append(b)
        self.vectors = np.array(queue)
        shape = (len(queue), NONE + 1)
        self.one, self.one_add = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.step, self.to = np.zeros((*shape, 4), np.int64), np.zeros((*shape, 4), np.int64)
        names: dict[tuple[tuple[str, ...], str, str | None], int] = {}
        self.edits: list[tuple[tuple[str, ...], str, str | None]] = []

        def number(edit: tuple[tuple[str, ...], str, str | None]) -> int:
            if edit not in names:
                names[edit] = len(names)
                self.edits.append(edit)
            return names[edit]

        for (v, costs), s in itertools.product(enumerate(queue), range(NONE + 1)):
            own = before(costs, s)
            self.one[v, s], self.one_add[v, s] = known[normal(own)], min(own)
            for q in range(4):
                at, inserted = q, []
                while True:  # letters in order: D, I, K, R
                    fits = {a: (role, q2) for c, a, role, q2 in moves(at, s) if c + costs[q2] == own[at]} if s != NONE else {}
                    if s == NONE:
                        self.step[v, s, q], self.to[v, s, q] = number(((), "", None)), q
                        break
                    if "D" in fits or INSERT + own[STATE[NEXT[at]]] != own[at]:
                        letter = min(fits)
                        self.step[v, s, q], self.to[v, s, q] = number((tuple(inserted), letter, fits[letter][0])), fits[letter][1]
                        break
                    inserted.append(NEXT[at])
                    at = STATE[NEXT[at]]
        self.finish = np.zeros(4, np.int64)
        for q in range(4):
            at, inserted = q, []
            while END[at] > 0:
                inserted.append(NEXT[at])
                at = STATE[NEXT[at]]
            self.finish[q] = number((tuple(inserted), "", None))
        # blocks are numbers in base NONE + 1, the first symbol leading: the table for k + 1 symbols comes from that for k
        self.block, self.block_add = self.one, self.one_add
        for _ in range(BLOCK - 1):
            behind = self.block[:, None, :]
            first = np.arange(NONE + 1)[None, :, None]
            add = self.block_add[:, None, :] + self.one_add[behind, first]
            self.block, self.block_add = self.one[behind, first].reshape(len(queue), -1), add.reshape(len(queue), -1)
        spelled = [("I" * len(i) + a).encode() for i, a, _ in self.edits]
        self.length = np.array([len(x) for x in spelled])
        self.letters = np.zeros((len(spelled), max(self.length)), np.uint8)
        for i, x in enumerate(spelled):
            self.letters[i, : len(x)] = list(x)


@cache
def tables() -> Tables:
    return Tables()


def repaired(rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost of each conversation, edit of each row, edit after the last row) for conversations laid end to end as bytes of
    their rows: conversation i ends before ends[i]."""
    t = tables()
    size = np.diff(ends, prepend=0)
    blocks = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    symbols = np.full(int(blocks.sum()) * BLOCK, NONE, np.int64)
    own = np.repeat(np.arange(len(ends)), size)
    place = first[own] * BLOCK + np.arange(len(rows)) - (ends - size)[own]
    symbols[place] = SYMBOL[rows]
    symbols = symbols.reshape(-1, BLOCK)
    code = symbols @ (NONE + 1) ** np.arange(BLOCK - 1, -1, -1)
    behind = np.zeros(len(code), np.int64)  # vector behind each block
    vector, cost = np.zeros(len(ends), np.int64), np.full(len(ends), int(min(END)))
    order = np.argsort(-blocks, kind="stable")
    reach = np.searchsorted(-blocks[order], -np.arange(1, blocks.max(initial=0) + 1), "right")  # how many have so many blocks
    for k in range(len(reach) - 1, -1, -1):
        who = order[: reach[k]]
        at = first[who] + k
        behind[at] = vector[who]
        cost[who] += t.block_add[vector[who], code[at]]
        vector[who] = t.block[vector[who], code[at]]
    cost = cost + t.vectors[vector, EMPTY].astype(np.int64)
    edits = np.zeros(symbols.shape, np.int64)
    state = np.zeros(len(ends), np.int64)
    # inner vectors of all blocks, expanded backwards
    inner = np.zeros(symbols.shape, np.int64)
    for j in range(BLOCK - 1, -1, -1):
        inner[:, j] = behind if j == BLOCK - 1 else t.one[inner[:, j + 1], symbols[:, j + 1]]
    for k in range(len(reach)):
        who = order[: reach[k]]
        at, q = first[who] + k, state[who]
        for j in range(BLOCK):
            edits[at, j] = t.step[inner[at, j], symbols[at, j], q]
            q = t.to[inner[at, j], symbols[at, j], q]
        state[who] = q
    return cost, edits.ravel()[place], t.finish[state]


def audits(edits: np.ndarray, last: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The letters of each conversation's edits, as one string."""
    t = tables()
    all_, at = np.insert(edits, ends, last), ends + np.arange(1, len(ends) + 1)
    length = np.concatenate([[0], np.cumsum(t.length[all_])])
    flat = t.letters[all_][np.arange(t.letters.shape[1]) < t.length[all_][:, None]]
    offsets = np.concatenate([[0], length[at]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


# tables


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) damaged by their hash: `copies` holds none, one or two rows (role, text)."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    one = F.struct(F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"))
    copies = F.when(kind == 0, F.array().cast("array<struct<role:string,text:string>>")).when(kind == 3, F.array(one, one)).otherwise(F.array(one))
    return rows.select("conv_id", "turn", copies.alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same form for rows as they are, nulls as one space."""
    one = F.struct(F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.select("conv_id", "turn", F.array(one).alias("copies"))


def row_byte(role: Column, text: Column) -> Column:
    """A row's byte by itself: initial, and whether it is blank or truncated."""
    initial = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    initial = F.when((F.length(role) > 0) & (initial > 0), initial - 1).otherwise(3)
    bare = F.rtrim(text, F.lit("\t\n\x0b\f\r "))
    fault = F.when(F.length(bare) == 0, 3).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    return (initial + 4 * fault).cast("int")


SUMMARY = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(given: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows of a conversation go by turn, nulls first; of one turn by role, then text. A null conv_id is a conversation like
    others. Roles but for those that begin with s, u or a, the empty one included, fit nowhere. Conversations without a row
    left have zeros, an empty audit and the empty text's hash. Texts may be of any length, and a conversation of any number
    of rows: a byte a row meets in one task, and texts pass one by one through the task that hashes its conversation. An empty
    table gives no rows.
    """
    given = modest_batches(given).withColumn("_salt", F.monotonically_increasing_id())  # equal rows needn't meet
    each = given.select("conv_id", "turn", "_salt", F.explode_outer("copies").alias("m")).select("conv_id", "turn", F.col("m.role").alias("role"), F.col("m.text").alias("text"), "_salt")
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "_salt"]
    sorted_ = each.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_ = sorted_.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), row_byte(F.col("role"), F.col("text")).alias("b"), F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("same"))
    rows = cut(sorted_, "turns")
    there = rows.where("role is not null")

    first = there.groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    told = there.select("conv_id", "at", "b").join(first, "at", "left")
    byte = F.when(F.col("first") | (F.col("b") >= 12), F.col("b")).otherwise(F.col("b") % 4 + 8)
    piece = told.groupBy("conv_id", F.shiftright("at", 33).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", byte.alias("b")))).alias("l"))
    piece = piece.select("conv_id", "piece", F.concat_ws("", F.transform("l", lambda x: F.char(x["b"] + 65))).alias("s"))
    strings = piece.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"])).alias("bytes"))
    turns = there.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    light = rows.select("conv_id").distinct()
    null_safe = lambda a, b: a.join(b.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    every = null_safe(null_safe(light, strings), turns).select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("bytes", F.lit("")).alias("bytes"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, ends = text_bytes(batch.column(2))
            b, ends = b.astype(np.int64) - 65, ends[1:]
            cost, edits, last = repaired(b, ends)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
            initial, fault = b % 4, b // 4
            pair = initial[:-1] * 4 + initial[1:]
            wrong = np.append(~np.isin(pair, [1, 6, 9]), False)  # su, ua, au
            wrong[ends[ends > 0] - 1] = False  # no pair across conversations
            plan = np.insert(edits, ends, last).astype(np.uint8).tobytes()
            at = ends + np.arange(1, len(ends) + 1)
            plans = [plan[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(total(fault == f)) for f in (3, 2, 1)), pa.array(total(wrong)), pa.array(cost), audits(edits, last, ends).cast(pa.string()), pa.array(plans, pa.binary())],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "plan"],
            )

    kind = rows.schema["conv_id"].dataType.simpleString()
    summary = SUMMARY.format(kind)
    done = every.mapInArrow(planned, f"{summary}, plan binary").withColumns({"at": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    streamed = done.unionByName(there.select("conv_id", "at", "role", "text"), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    out = cut(streamed.mapInArrow(hashed, f"{summary}, repaired_sha256 string"), "repairs")
    drop(rows)
    return out


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries with the hash of the repaired text, of conversations in a sorted stream: a row with the summary and the
    plan, then one for each message."""
    edits = tables().edits
    head: tuple | None = None
    plan, k, line, digest = b"", 0, False, hashlib.sha256()
    out: list[tuple] = []
    schema = None

    def put(inserted: tuple[str, ...], *message: str) -> None:
        nonlocal line
        for part in (*(f"{role}:" for role in inserted), *message):
            digest.update(f"{chr(10) if line else ''}{part}".encode("utf-8", "surrogatepass"))
            line = True

    def close() -> None:
        if head is not None:
            put(edits[plan[-1]][0])
            out.append((*head, digest.hexdigest()))

    def taken() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        schema = pa.schema([*(batch.schema.field(n) for n in names), pa.field("repaired_sha256", pa.string())])
        for own, role, text, *first in zip(*(batch.column(n).to_pylist() for n in ("plan", "role", "text", *names)), strict=True):
            if own is not None:
                close()
                head, plan, k, line, digest = tuple(first), own, 0, False, hashlib.sha256()
                continue
            inserted, letter, new = edits[plan[k]]
            k += 1
            put(inserted, *([] if letter == "D" else [f"{role if new is None else new}:{text}"]))
        yield taken()
    if schema is not None:
        close()
        yield taken()


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


# the same in SQL: for each state of the pattern the cheapest edits so far, the least of equals, row by row


def _cheapest_sql() -> str:
    none = "{'c': 1000000000::bigint, 'a': '', 'o': []::varchar[]}"
    edit = lambda e, cost, letter, line=None: f"{{'c': {e}.c + {cost}, 'a': {e}.a || '{letter}', 'o': {e}.o" + (f" || [{line}]" if line else "") + "}"
    put = lambda e, who: edit(e, INSERT, "I", f"'{who}:'")
    kept = lambda e: edit(e, f"({KEEP} + cut)", "K", "role || ':' || text")
    new = lambda e, who: edit(e, f"({REROLE} + cut)", "R", f"'{who}:' || text")
    only = lambda condition, e: f"case when {condition} then {e} else {none} end"
    fits = lambda e, i, who: f"{only(f'not gone and i = {chr(39)}{i}{chr(39)}', kept(e))}, {only('not gone', new(e, who))}"
    crc = """list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(id) + 1), lambda k: ascii(substr(id, k, 1))::ubigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda j: j::ubigint)), lambda d, j: case when d % 2 = 1 then xor(d >> 1, 3988292384::ubigint) else d >> 1 end))"""
    return f"""with recursive given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as id from conversations),
  hashed as (select *, xor({crc}, 4294967295::ubigint) % 20 as kind from given),
  damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from hashed),
  placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as r, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damaged),
  told as (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '?' end as i,
      case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by r) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from placed),
  counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
      count(*) filter (where before || i not in ('su', 'ua', 'au')) as illegal from (select *, lag(i) over (partition by conv_id order by r) as before from told) group by conv_id),
  fold(conv_id, r, e0, e1, e2, e3) as (
    select conv_id, 0::bigint, z, {none}, {put('z', 'user')}, {put('(' + put('z', 'user') + ')', 'assistant')} from (select distinct conv_id, {{'c': 0::bigint, 'a': '', 'o': []::varchar[]}} as z from conversations)
    union all
    select conv_id, r, n0, n1, least(m2, {put('m3', 'user')}), m3 from (select *, least(n3, {put('m2', 'assistant')}) as m3 from (select *, least(n2, {put('n0', 'user')}, {put('n1', 'user')}, {put('n3', 'user')}) as m2 from (
      select f.conv_id, t.r, {edit('e0', DELETE, 'D')} as n0, least({edit('e1', DELETE, 'D')}, {only("not gone and i = 's'", kept('e0'))}) as n1,
        least({edit('e2', DELETE, 'D')}, {fits('e0', 'u', 'user')}, {fits('e1', 'u', 'user')}, {fits('e3', 'u', 'user')}) as n2, least({edit('e3', DELETE, 'D')}, {fits('e2', 'a', 'assistant')}) as n3
      from fold f join (select *, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then {UNTIDY} else 0 end as cut from told) t on t.conv_id is not distinct from f.conv_id and t.r = f.r + 1)))),
  done as (select conv_id, arg_max(least(e0, e3), r) as best from fold group by conv_id)
  select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit, sha256(array_to_string(best.o, chr(10))) as repaired_sha256
    from done d left join counted c on c.conv_id is not distinct from d.conv_id"""


ORACLE = _cheapest_sql()
