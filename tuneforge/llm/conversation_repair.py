"""Repair of conversation structure by the cheapest edits, with Hirschberg's divide and conquer.

The role initials of a repaired conversation read ``(s?(ua)+)?``. What stands so far is one of four
states (nothing, s, u, a); a row is a 4 x 4 table of the least cost from state to state, with
insertions before it, and of the order of the edit strings (audits) that give these costs. To find
an audit, forward costs of the first half and backward costs of the second meet in the middle of a
conversation; of the states with the least sum, the one whose forward audit is least in ASCII order
is crossed, and both halves are solved likewise. Only vectors of four costs and ranks are kept for
each run, so space is linear. Audits to one row that end in an edit of that row are prefix-free,
so ranks suffice to compare whole audits.

Scale: rows are range-partitioned by conversation and turn, so a conversation of any length is dealt
over many tasks. A task cuts what it has of a conversation into blocks of ``BLOCK`` rows.
Conversations that lie within one block are solved there; of the others each block gives its 4 x 4
table (tables of blocks combine as rows do), blocks are cut into blocks again until one covers a
conversation, and the states crossed at the ends of each block are carried down. Identical rows
of one turn are one row with a number of copies. The digest of such a conversation is a running hash over its
blocks in order, a task holding one block's text.

Odd rows: null roles and texts are one space (no role; blank). Null turns come first and have no
place in the gaps; a null conv_id is a conversation of its own. Rows of one turn are taken by role
and text. A conversation without rows gives zeros, an empty audit and the hash of the empty string.
An empty table has no conversations. Further columns are not read; very long texts are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tuneforge.llm.common import written

#: Rows (or blocks) of one block, and about how many characters of text it holds.
BLOCK, BLOCK_CHARS = 4096, 4_000_000
#: Rows of whole conversations that are solved together.
TOGETHER = 16_384
FAR = 1 << 40
#: Costs fixed by the task: insert, delete, rerole, an undeleted truncated row.
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
#: Least cost and inserted rows that end a conversation from each state.
END_COST, END_ROWS = np.array([0, 2 * INSERT, INSERT, 0]), [0, 2, 1, 0]
OTHER = 3
SPACE = r"[\x20\x09-\x0D]"


def _emit(state: int) -> int:
    """The state after a user or assistant row, whichever may follow."""
    return 3 if state == 2 else 2


def _tables() -> tuple[np.ndarray, np.ndarray, list]:
    """For each kind of row (initial + 4 if truncated + 8 if it must go): least cost from state to
    state, rank of its edits among the ends of one start, and the edits themselves."""
    costs, ranks = np.full((16, 4, 4), FAR, np.int64), np.zeros((16, 4, 4), np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(16)]
    for kind in range(16):
        initial, cut, must = kind % 4, kind // 4 % 2, kind // 8
        for start in range(4):
            ways, state = [], start
            for k in range(3):
                ways.append((k * INSERT + DELETE, "I" * k + "D", state))
                if not must:
                    keep = {0: 1 if state == 0 else None, 1: None if state == 2 else 2, 2: 3 if state == 2 else None}.get(initial)
                    if keep is not None:
                        ways.append((k * INSERT + cut * CUT, "I" * k + "K", keep))
                    ways.append((k * INSERT + cut * CUT + REROLE, "I" * k + "R", _emit(state)))
                state = _emit(state)
            for cost, text, end in sorted(ways, reverse=True):
                costs[kind, start, end], edits[kind][start][end] = cost, text
            for rank, end in enumerate(sorted(range(4), key=lambda e: edits[kind][start][e])):
                ranks[kind, start, end] = rank
    return costs, ranks, edits


COSTS, RANKS, EDITS = _tables()


def _forward(costs: np.ndarray, ranks: np.ndarray, start: np.ndarray, stop: np.ndarray, f: np.ndarray, r: np.ndarray) -> None:
    """Carry costs ``f`` and audit ranks ``r`` [runs, 4] over the rows start..stop of each run, in place."""
    order = np.argsort(start - stop, kind="stable")
    length = (stop - start)[order]
    for t in range(int(length[0]) if len(length) else 0):
        on = order[: np.searchsorted(-length, -t)]
        c, k = costs[start[on] + t], ranks[start[on] + t]
        total = f[on][:, :, None] + c
        best = np.argmin(total * 8 + r[on][:, :, None], axis=1)[:, None, :]
        f[on] = np.take_along_axis(total, best, 1)[:, 0]
        text = np.take_along_axis(r[on][:, :, None] * 8 + k, best, 1)[:, 0]
        r[on] = (text[:, None, :] < text[:, :, None]).sum(-1)


def _backward(costs: np.ndarray, start: np.ndarray, stop: np.ndarray, b: np.ndarray) -> None:
    """Carry costs to the end ``b`` [runs, 4] from stop back to start, in place."""
    order = np.argsort(start - stop, kind="stable")
    length = (stop - start)[order]
    for t in range(int(length[0]) if len(length) else 0):
        on = order[: np.searchsorted(-length, -t)]
        b[on] = (costs[stop[on] - 1 - t] + b[on][:, None, :]).min(2)


def crossings(costs: np.ndarray, ranks: np.ndarray, start: np.ndarray, stop: np.ndarray, entry: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state after each row on the cheapest and then audit-least way of each run, from the state
    ``entry`` to the end costs ``end`` [runs, 4]. All runs of one depth of the recursion go together."""
    after = np.zeros(len(costs), np.int64)
    live = stop > start
    start, stop, entry, end = start[live], stop[live], entry[live], end[live]
    while len(start):
        one = stop - start == 1
        if one.any():
            c, k = costs[start[one], entry[one]], ranks[start[one], entry[one]]
            after[start[one]] = np.argmin((c + end[one]) * 8 + k, axis=1)
            start, stop, entry, end = start[~one], stop[~one], entry[~one], end[~one]
        middle = (start + stop) // 2
        f = np.full((len(start), 4), FAR, np.int64)
        f[np.arange(len(start)), entry] = 0
        r = np.zeros_like(f)
        _forward(costs, ranks, start, middle, f, r)
        b = end.copy()
        _backward(costs, middle, stop, b)
        crossed = np.argmin((f + b) * 8 + r, axis=1)
        only = np.full((len(start), 4), FAR, np.int64)
        only[np.arange(len(start)), crossed] = 0
        start, stop = np.concatenate([start, middle]), np.concatenate([middle, stop])
        entry, end = np.concatenate([entry, crossed]), np.concatenate([only, end])
    return after


def products(costs: np.ndarray, ranks: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables [runs, 4, 4] of whole runs."""
    n = len(start)
    f = np.full((n, 4, 4), FAR, np.int64)
    f[:, np.arange(4), np.arange(4)] = 0
    f, r = f.reshape(-1, 4), np.zeros((4 * n, 4), np.int64)
    _forward(costs, ranks, np.repeat(start, 4), np.repeat(stop, 4), f, r)
    return np.minimum(f, FAR).reshape(n, 4, 4), r.reshape(n, 4, 4)


def _row_tables(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with a kind and copies: further copies of a row are deleted right after it."""
    kinds = np.array([r["kind"] for r in rows], np.int64)
    more = np.array([r["copies"] - 1 for r in rows], np.int64)
    return np.minimum(COSTS[kinds] + DELETE * more[:, None, None], FAR), RANKS[kinds]


def _edited(rows: list[dict], after: np.ndarray, entry: int, last: bool) -> tuple[str, list[dict]]:
    """The audit of a run and the rows that it leaves."""
    audit, kept, state = [], [], entry
    add = lambda text: kept.append({"role": "assistant" if state == 3 else "user", "text": text})
    for row, to in zip(rows, after.tolist(), strict=True):
        edit = EDITS[row["kind"]][state][to]
        for _ in range(edit.count("I")):
            state = _emit(state)
            add("")
        if edit[-1] == "K":
            kept.append({"role": row["role"], "text": row["text"]})
            state = to
        elif edit[-1] == "R":
            state = to
            add(row["text"])
        audit.append(edit + "D" * (row["copies"] - 1))
    for _ in range(END_ROWS[state] if last else 0):
        state = _emit(state)
        audit.append("I")
        add("")
    return "".join(audit), kept


INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
_STATS = "n long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_BLOCK = (
    f"part int, chunk int, open boolean, stats struct<{_STATS.replace(' long', ':long').replace(' string', ':string')}>, cost long, audit string, "
    "rows array<struct<role:string,text:string>>, edits array<struct<kind:int,copies:long,role:string,text:string>>, costs array<long>, ranks array<long>"
)


def _stats(rows: list[dict]) -> dict:
    """Counts of one block; those of neighbours are added by ``_joined``."""
    out = {"n": 0, "turns": 0, "first_turn": None, "last_turn": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_role": None, "last_role": None}
    for r in rows:
        initial = r["role"][:1]
        single = {
            "n": r["copies"], "turns": int(r["turn"] is not None), "first_turn": r["turn"], "last_turn": r["turn"],
            "blank": r["copies"] * r["blank"], "duplicate": (r["copies"] - 1 + r["again"]) * (not r["blank"]),
            "truncated": int(not r["blank"] and not r["again"] and not r["ended"]), "illegal": r["copies"] - 1, "first_role": initial, "last_role": initial,
        }
        out = _joined(out, single)
    return out


def _joined(a: dict, b: dict) -> dict:
    """Counts of a stretch of rows and the next one."""
    if not a["n"] or not b["n"]:
        return b if b["n"] else a
    out = {k: a[k] + b[k] for k in ("n", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out |= {"first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"], "last_turn": b["last_turn"], "first_role": a["first_role"], "last_role": b["last_role"]}
    return out


def _kind(r: dict) -> int:
    return INITIALS.get(r["role"][:1], OTHER) + 4 * (not r["ended"]) + 8 * (r["blank"] or r["again"])


def _solved(blocks: list[dict], part: int) -> list[dict]:
    """Rows of the block table: whole conversations are edited, others give their tables."""
    rows = [r for b in blocks for r in b["rows"]]
    costs, ranks = _row_tables(rows)
    stop = np.cumsum([len(b["rows"]) for b in blocks])
    start = stop - [len(b["rows"]) for b in blocks]
    whole = np.array([not b["open"] for b in blocks])
    after = crossings(costs, ranks, start[whole], stop[whole], np.zeros(int(whole.sum()), np.int64), np.tile(END_COST, (int(whole.sum()), 1)))
    c, k = products(costs, ranks, start[~whole], stop[~whole])
    out, at = [], 0
    for i, b in enumerate(blocks):
        row = {"conv_id": b["conv_id"], "part": part, "chunk": b["chunk"], "open": b["open"], "stats": _stats(b["rows"])}
        if b["open"]:
            row |= {"edits": b["rows"], "costs": c[at].ravel().tolist(), "ranks": k[at].ravel().tolist()}
            at += 1
        else:
            audit, kept = _edited(b["rows"], after[start[i] : stop[i]], 0, True)
            states = np.concatenate([[0], after[start[i] : stop[i]]])
            row |= {"audit": audit, "rows": kept, "cost": int(costs[np.arange(start[i], stop[i]), states[:-1], states[1:]].sum() + END_COST[states[-1]])}
        out.append(row)
    return out


def _blocks(schema: pa.Schema, block: int):
    """Cut sorted rows into blocks and solve those that are whole conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: list[dict] = []
        now = None

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(_solved(waiting, part), schema=schema)
            waiting.clear()
            return out

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                conv = r.pop("conv_id")
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        waiting.append(now)
                    now = {"conv_id": conv, "chunk": 0, "rows": [], "open": now is None, "chars": 0}  # the first may have begun in another task
                if r["copies"]:
                    if len(now["rows"]) >= block or now["chars"] >= BLOCK_CHARS:
                        waiting.append(now | {"open": True})
                        now = {"conv_id": conv, "chunk": now["chunk"] + 1, "rows": [], "open": True, "chars": 0}
                    now["rows"].append(r | {"kind": _kind(r)})
                    now["chars"] += len(r["text"])
                    size += 1 + len(r["text"]) // 256
                if size >= TOGETHER and waiting:
                    yield give()
                    size = len(now["rows"])
        if now is not None:
            waiting.append(now | {"open": True})  # the last may go on in another task
            yield give()
    return run


def _schema(df: DataFrame, ddl: str) -> StructType:
    return StructType([df.schema["conv_id"], *StructType.fromDDL(ddl)])


def _pieces(schema: pa.Schema, block: int):
    """Cut the sorted blocks of each conversation into blocks of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def give() -> pa.RecordBatch:
            n = np.array([0]), np.array([len(held)])
            c, k = products(*_element_tables(held), *n)
            row = {"conv_id": held[0]["conv_id"], "part": held[0]["part"], "chunk": held[0]["chunk"], "members": held, "costs": c[0].ravel().tolist(), "ranks": k[0].ravel().tolist()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (held[0]["conv_id"] != r["conv_id"] or len(held) >= block):
                    yield give()
                    held = []
                held.append(r)
        if held:
            yield give()
    return run


def _element_tables(members: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([m[name] for m in members], np.int64).reshape(-1, 4, 4) for name in ("costs", "ranks"))


def _ends(target: int) -> np.ndarray:
    return END_COST.copy() if target < 0 else np.where(np.arange(4) == target, 0, FAR)


def _carry(schema: pa.Schema):
    """The states at which the members of each piece begin and end; target -1 is the end of a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                members = piece["members"]
                after = crossings(*_element_tables(members), np.array([0]), np.array([len(members)]), np.array([piece["entry"]]), _ends(piece["target"])[None])
                entries, targets = [piece["entry"], *after[:-1].tolist()], [*after[:-1].tolist(), piece["target"]]
                rows = [{"conv_id": piece["conv_id"], "part": m["part"], "chunk": m["chunk"], "entry": e, "target": t} for m, e, t in zip(members, entries, targets, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"]) & (a["chunk"] == b["chunk"])


def _states(blocks: DataFrame, block: int) -> DataFrame:
    """conv_id, part, chunk, entry, target of blocks (conv_id, part, chunk, costs, ranks): blocks of
    blocks are made until one covers a conversation, then the crossed states are carried down."""
    out = _schema(blocks, "part int, chunk int, members array<struct<part:int,chunk:int,costs:array<long>,ranks:array<long>>>, costs array<long>, ranks array<long>")
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    pieces = written(ordered.mapInArrow(_pieces(to_arrow_schema(out), block), out))
    if pieces.groupBy("conv_id").count().where("count > 1").isEmpty():
        found = pieces.withColumns({"entry": F.lit(0), "target": F.lit(-1)})
    else:
        above = _states(pieces.select("conv_id", "part", "chunk", "costs", "ranks"), block)
        found = pieces.join(above, _same(pieces, above)).select(pieces["*"], above["entry"], above["target"])
    ends = _schema(blocks, "part int, chunk int, entry int, target int")
    return found.mapInArrow(_carry(to_arrow_schema(ends)), ends)


def _finish(schema: pa.Schema):
    """Edit blocks between their states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                rows, target = b["edits"], b["target"]
                audit, kept, cost = "", [], 0
                if rows:
                    costs, ranks = _row_tables(rows)
                    after = crossings(costs, ranks, np.array([0]), np.array([len(rows)]), np.array([b["entry"]]), _ends(target)[None])
                    states = np.concatenate([[b["entry"]], after])
                    audit, kept = _edited(rows, after, b["entry"], target < 0)
                    cost = int(costs[np.arange(len(rows)), states[:-1], states[1:]].sum() + (END_COST[states[-1]] if target < 0 else 0))
                elif target < 0:
                    audit, kept = _edited([], np.empty(0, np.int64), b["entry"], True)
                    cost = int(END_COST[b["entry"]])
                yield pa.RecordBatch.from_pylist([{k: b[k] for k in ("conv_id", "part", "chunk", "open", "stats")} | {"cost": cost, "audit": audit, "rows": kept}], schema=schema)
    return run


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32('conv_id:turn') % 20. A dropped row
    has no copies; it only tells that its conversation is there."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"),
                                (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("fault"))
    def unless_lost(value: Column, lost: Column) -> Column:
        return F.when(F.col("fault") == 0, lost).otherwise(value)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", unless_lost(F.col("turn"), F.lit(None)).alias("turn"), unless_lost(F.when(F.col("fault") == 4, "user").otherwise(F.col("role")), F.lit("")).alias("role"),
        unless_lost(text, F.lit("")).alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repair conversations given as conv_id, turn, role, text, copies (0: no row, only a mark that
    the conversation is there). One row for each block of a conversation, in the order of part and
    chunk (most conversations have one): its counts before the repair, cost, audit and repaired rows."""
    if block < 2:
        raise ValueError("a block must have two rows at least")
    rows = rows.groupBy("conv_id", (F.col("copies") == 0).alias("gone"), "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    said = rows.where("not gone").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    said = said.select(F.col("conv_id").alias("said_conv"), F.col("role").alias("said_role"), F.col("digest").alias("said_digest"), F.col("place").alias("said_place"))
    same = F.col("conv_id").eqNullSafe(F.col("said_conv")) & (F.col("role") == F.col("said_role")) & (F.col("digest") == F.col("said_digest"))
    flagged = rows.join(said, same, "left").select(
        "conv_id", "turn", "role", "text", "copies", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.coalesce(place > F.col("said_place"), F.lit(False)).alias("again"), F.col("text").rlike(rf"[.!?]{SPACE}*\z").alias("ended"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    out = _schema(rows, _BLOCK)
    blocks = written(flagged.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks(to_arrow_schema(out), block), out))
    unfinished = blocks.where("open")
    ends = written(_states(unfinished.select("conv_id", "part", "chunk", "costs", "ranks"), block))
    todo = unfinished.join(ends, _same(unfinished, ends)).select(unfinished["*"], ends["entry"], ends["target"])
    done = StructType([f for f in out if f.name not in ("edits", "costs", "ranks")])
    finished = todo.mapInArrow(_finish(to_arrow_schema(done)), done)
    return blocks.where("not open").select(*done.names).unionByName(finished)


def repaired_rows(blocks: DataFrame) -> DataFrame:
    """conv_id, part, chunk, place, role, text: the repaired conversations, in the order of part, chunk and place."""
    return blocks.select("conv_id", "part", "chunk", F.posexplode("rows").alias("place", "row")).select("conv_id", "part", "chunk", "place", "row.role", "row.text")


_DIGEST = f"{_STATS}, cost long, audit string, repaired_sha256 string"


def _hashed(schema: pa.Schema):
    """Join the blocks of each conversation, in order, with a running hash of the repaired rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def give() -> pa.RecordBatch:
            row = {"conv_id": now["conv_id"], "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([now["stats"] | row], schema=schema)

        for batch in batches:
            for b in batch.to_pylist():
                if now is None or now["conv_id"] != b["conv_id"]:
                    if now is not None:
                        yield give()
                    now = {"conv_id": b["conv_id"], "cost": 0, "audit": [], "hash": hashlib.sha256(), "stats": _stats([]), "any": False}
                now["cost"] += b["cost"]
                now["audit"].append(b["audit"])
                now["stats"] = _joined(now["stats"], b["stats"])
                if b["lines"] is not None:
                    now["hash"].update((("\n" if now["any"] else "") + b["lines"]).encode())
                    now["any"] = True
        if now is not None:
            yield give()
    return run


def digest(blocks: DataFrame) -> DataFrame:
    """One row for each conversation: counts before the repair, cost, audit, hash of the repaired rows."""
    lines = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    rows = blocks.select("conv_id", "part", "chunk", "open", "stats", "cost", "audit", lines.alias("lines"))
    alone = rows.where("not open").select("conv_id", "stats.*", "cost", "audit", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))
    out = _schema(blocks, _DIGEST)
    many = rows.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_hashed(to_arrow_schema(out)), out)
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    return alone.unionByName(many).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
