"""Conversation structure repair: the lightest edits that make a conversation ``(s?(ua)+)?``, by Knuth's agenda over weighted deductions.

An item [i, j, p -> q] says that rows i to j, as edited, take the grammar from state p to state q. Axioms are the edits of one row (keep, rerole,
delete) and insertions between rows; a deduction joins two neighbouring items. Its function adds costs and joins audits, so it is monotone, and in
the order (cost, rows covered, audit) superior: a result comes after both of its antecedents, as what costs nothing covers a row. Items
of one span cover the same rows, so each is final, with its least (cost, audit), when it is popped, and the search ends when the goal is.

1. Rows are sorted by conversation and turn over ranges that may begin and end inside a conversation, so a long one is many tasks'.
2. A conversation that lies inside its task is repaired there. Others are cut into parts of at most PART rows. Each part's agenda runs to its end
   and gives the items of all states; parts are then joined by the same deduction, in order, from one row for a part.
3. Parts are edited by their own piece of the audit, all of them in parallel.

Repeated rows of long conversations are found by digests that are grouped over parts.

Cases: null turns come first and count for no gap; null roles and texts are one blank; a null conv_id is a conversation of its own; rows of one turn are
ordered by role, the first 64 characters of the text, and a hash of it; roles other than system, user and assistant count by their first
letter; a conversation without rows gives zeros and no turns; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, load, parallelism

START, SYSTEM, USER, DONE = range(4)
#: The grammar: the state that a role's initial leads to.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
ENDS = (START, DONE)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT = 2, 3, 2
#: Rows and characters of a part.
PART, PART_CHARS = 512, 4 << 20
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
MAX_LONG = (1 << 63) - 1
#: What is known of a row: its role's initial, whether it must go, what it costs to leave it.
Row = tuple[str, bool, int]
Weight = tuple[int, int, str]


def joined(left: Weight, right: Weight) -> Weight:
    """The weight (cost, rows covered, audit) of a deduction from two neighbouring items."""
    return left[0] + right[0], left[1] + right[1], left[2] + right[2]


def axioms(row: Row | None, state: int) -> list[tuple[Weight, int]]:
    """Edits of the next row, if there is one, and insertions before it, with the states they lead to."""
    out = [((INSERT, 0, "I"), AFTER[state, x]) for x in "ua" if (state, x) in AFTER]
    if row is None:
        return out
    initial, must, more = row
    out.append(((DELETE, 1, "D"), state))
    if not must:
        out += [((REROLE + more, 1, "R"), AFTER[state, x]) for x in "ua" if (state, x) in AFTER]
        if (state, initial) in AFTER:
            out.append(((more, 1, "K"), AFTER[state, initial]))
    return out


def lightest(rows: list[Row], origins: tuple[int, ...] = (START,), goal: bool = True) -> dict[tuple[int, int], tuple[int, str]]:
    """(origin, state): (cost, audit) of items that cover all rows: the goal alone, as soon as it is final, or all of them."""
    final, out = set(), {}
    agenda = [((0, 0, ""), p, p) for p in origins]
    while agenda:
        weight, origin, state = heapq.heappop(agenda)
        at = weight[1]
        if (origin, at, state) in final:
            continue
        final.add((origin, at, state))
        if at == len(rows) and (not goal or state in ENDS):
            out[origin, state] = weight[0], weight[2]
            if goal:
                break
        for edit, to in axioms(rows[at] if at < len(rows) else None, state):
            if (origin, at + edit[1], to) not in final:
                heapq.heappush(agenda, (joined(weight, edit), origin, to))
    return out


def edited(turns: list[tuple[str, str]], audit: str, state: int = START) -> list[dict]:
    """The turns (role, text) that an audit leaves, begun in a state of the grammar."""
    out, at = [], 0
    for letter in audit:
        if letter != "I":
            role, text = turns[at]
            at += 1
        if letter == "D":
            continue
        if letter == "K":
            initial = role[:1]
        else:
            initial = "a" if state == USER else "u"
            role, text = ROLES[initial], text if letter == "R" else ""
        state = AFTER[state, initial]
        out.append({"edit": letter, "role": role, "text": text})
    return out


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Rows:
    """The rows of a conversation, or of a part of one, in order."""

    def __init__(self):
        self.turns, self.codes, self.digests, self.seen, self.chars = [], [], [], set(), 0
        self.low = self.high = None
        self.distinct = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, conversation, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        solid = text.rstrip(WHITE)
        known = hashlib.blake2b(f"{conversation}\0{role}\0{text}".encode(), digest_size=16).digest()
        blank, again = not solid, (role, text) in self.seen
        late = not blank and not again and solid[-1] not in ".!?"
        self.illegal += bool(self.codes) and not _legal(self.codes[-1][0], role[:1])
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += late
        self.codes.append((role[:1], blank or again, int(late)))
        self.digests.append(known)
        self.seen.add((role, text))
        self.turns.append((role, text))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.turns) >= PART or self.chars >= PART_CHARS

    def row(self, conversation, part: int | None) -> dict:
        """A whole conversation, repaired; or a part with what the rest of its conversation needs to know."""
        out = {
            "conv_id": conversation, "part": part, "low": self.low, "high": self.high, "distinct": self.distinct, "blank": self.blank,
            "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
        }
        if part is None:
            ((cost, audit),) = lightest(self.codes).values()
            return out | {"cost": cost, "audit": audit, "turns": edited(self.turns, audit)}
        codes = [{"initial": c[0], "must": c[1], "more": c[2]} for c in self.codes]
        return out | {"turns": [{"role": r, "text": t} for r, t in self.turns], "codes": codes, "digests": self.digests}


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_CODES = pa.list_(pa.struct([("initial", pa.string()), ("must", pa.bool_()), ("more", pa.int64())]))
_ITEMS = pa.list_(pa.struct([("origin", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))
_FACTS = ("part", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")
_FACTS_SQL = ", ".join(f"{c} long" for c in _FACTS)
_TURNS_SQL = "array<struct<edit:string,role:string,text:string>>"


def _batch(rows: list[dict], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in columns.items()], list(columns))


def _sorted(batches):
    """Whole conversations and parts of others, from rows in order. The first and the last one of a task may go on in others."""
    base, parts, out, held = TaskContext.get().partitionId() << 32, 0, [], 0
    rows, now, open_, columns = _Rows(), None, False, None
    begun = False  # whether rows is of a conversation that may lie in several parts

    for batch in batches:
        columns = {"conv_id": batch.schema.field(0).type} | {c: pa.int64() for c in _FACTS} | {"cost": pa.int64(), "audit": pa.string(), "turns": _TURNS, "codes": _CODES, "digests": pa.list_(pa.binary())}
        for conversation, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")), strict=True):
            if not open_:
                now, open_, begun = conversation, True, True
            elif conversation != now:
                out.append(rows.row(now, base + parts if begun else None))
                parts, held, rows, now, begun = parts + begun, held + rows.chars, _Rows(), conversation, False
            for _ in range(copies):
                if rows.full():
                    out.append(rows.row(now, base + parts))
                    parts, held, rows, begun = parts + 1, held + rows.chars, _Rows(), True
                rows.add(conversation, turn, role, text)
            if len(out) >= 4096 or held >= PART_CHARS:
                yield _batch(out, columns)
                out, held = [], 0
    if open_:
        out.append(rows.row(now, base + parts))
        yield _batch(out, columns)


def _part_items(batches):
    """The lightest items of each part, for all states that it may begin and end in."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            gone = set(row.pop("again") or ())
            rows = row.pop("codes")
            new = [c for i, c in enumerate(rows) if i in gone and not c["must"]]  # what repeats inside the part is known
            row["duplicate"] += len(new)
            row["truncated"] -= sum(c["more"] for c in new)
            codes = [(c["initial"], c["must"] or i in gone, c["more"]) for i, c in enumerate(rows)]
            found = lightest(codes, tuple(range(4)), goal=False)
            row["items"] = [{"origin": p, "state": q, "cost": c, "audit": a} for (p, q), (c, a) in found.items()]
            row["head"], row["tail"] = (codes[0][0], codes[-1][0]) if codes else (None, None)
            out.append(row)
        yield _batch(out, {"conv_id": batch.schema.field(0).type} | {c: pa.int64() for c in _FACTS} | {"head": pa.string(), "tail": pa.string(), "items": _ITEMS})


def _chained(conversation, parts) -> list[dict]:
    """For each part of a conversation its piece of the lightest audit and the state it begins in; the last one holds the report."""
    prefixes = {START: (0, 0, "", None)}  # cost, rows, audit, and where it came from: (the one before, state, piece)
    numbers, sums, low, high, tail = [], dict.fromkeys(("distinct", "blank", "duplicate", "truncated", "illegal"), 0), None, None, None
    for part in parts:
        best: dict[int, tuple] = {}
        for item in part["items"]:
            if before := prefixes.get(item["origin"]):
                weight = joined(before[:3], (item["cost"], 1, item["audit"]))
                if item["state"] not in best or weight < best[item["state"]][:3]:
                    best[item["state"]] = (*weight, (before, item["origin"], item["audit"]))
        prefixes = best
        numbers.append(part["part"])
        for c in sums:
            sums[c] += part[c]
        if part["head"] is not None:
            sums["illegal"] += tail is not None and not _legal(tail, part["head"])
            tail = part["tail"]
        if part["low"] is not None:
            sums["distinct"] -= part["low"] == high
            low, high = part["low"] if low is None else low, part["high"]
    goal = min(w for q, w in prefixes.items() if q in ENDS)
    report, pieces = {"low": low, "high": high, **sums, "cost": goal[0], "audit": goal[2]}, []
    while goal[3]:
        pieces.append(goal[3][1:])
        goal = goal[3][0]
    out = [{"conv_id": conversation, "part": n, "state": p, "piece": a} for n, (p, a) in zip(numbers, reversed(pieces), strict=True)]
    out[-1] |= report
    return out


_REPORT = ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "cost")


def _chains(batches):
    """Joins the parts of each conversation, which come in order: a row for a part."""
    now, parts, columns = None, [], None
    for batch in batches:
        columns = {"conv_id": batch.schema.field(0).type, "part": pa.int64(), "state": pa.int64(), "piece": pa.string(), **{c: pa.int64() for c in _REPORT}, "audit": pa.string()}
        for row in batch.to_pylist():
            if parts and row["conv_id"] != now:
                yield _batch(_chained(now, parts), columns)
                parts = []
            now = row["conv_id"]
            parts.append(row)
    if parts:
        yield _batch(_chained(now, parts), columns)


def _edit_parts(batches):
    for batch in batches:
        turns = [edited([(t["role"], t["text"]) for t in row["turns"]], row["piece"], row["state"]) for row in batch.select(["turns", "piece", "state"]).to_pylist()]
        columns = [pa.array(turns, _TURNS) if c == "turns" else batch.column(c) for c in batch.schema.names if c not in ("piece", "state")]
        yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c not in ("piece", "state")])


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations, of turns (conv_id, turn, role, text, and copies: how often the row stands there, 0 for none).

    A row is a conversation (part null) or a part of a long one, in the order of part; turns: what it has now (edit, role, text). The report
    (low, high, distinct: of its turns, blank, duplicate, truncated, illegal, cost, audit) is null in all parts but the last.
    """
    spark, stage = turns.sparkSession, Stage(turns.sparkSession, "repair")
    kind = turns.schema["conv_id"].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long"), blank("role"), blank("text"), F.col("copies").cast("long"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text")]
    # Equal rows stand for each other: a number at random deals them over ranges, too.
    dealt = rows.repartitionByRange(parallelism(spark), *order, F.rand(11)).sortWithinPartitions(*order)
    schema = f"conv_id {kind}, {_FACTS_SQL}, cost long, audit string, turns {_TURNS_SQL}, codes array<struct<initial:string,must:boolean,more:bigint>>, digests array<binary>"
    solved = stage.keep(dealt.mapInArrow(_sorted, schema), "solved")
    parts = solved.where("part is not null")
    known = parts.select("part", F.posexplode("digests").alias("pos", "digest"))
    first = known.groupBy("digest").agg(F.min("part").alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first")
    again = known.join(first, "digest").where("part > first").groupBy("part").agg(F.collect_list("pos").alias("again"))
    items = parts.select("conv_id", *_FACTS, "codes").join(again, "part", "left").select("conv_id", *_FACTS, "codes", "again")
    items = stage.keep(items.mapInArrow(_part_items, f"conv_id {kind}, {_FACTS_SQL}, head string, tail string, items array<struct<origin:bigint,state:bigint,cost:bigint,audit:string>>"), "items")
    chained = items.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    report = ", ".join(f"{c} long" for c in _REPORT)
    chains = stage.keep(chained.mapInArrow(_chains, f"conv_id {kind}, part long, state long, piece string, {report}, audit string"), "chains")
    stage.drop("items")
    long_ = parts.select("part", "turns").join(chains, "part").select("conv_id", "part", *_REPORT, "audit", "turns", "piece", "state")
    long_ = long_.mapInArrow(_edit_parts, f"conv_id {kind}, part long, {report}, audit string, turns {_TURNS_SQL}")
    return solved.where("part is null").select("conv_id", "part", *_REPORT, "audit", "turns").union(long_)


def _long_digests(batches):
    """The digest of a long conversation, from its parts in order, one at a time."""
    now, open_, hashed, some, out, columns = None, False, hashlib.sha256(), False, [], None
    report: dict = {}
    for batch in batches:
        columns = {"conv_id": batch.schema.field(0).type, **{c: pa.int64() for c in _REPORT}, "audit": pa.string(), "repaired_sha256": pa.string()}
        for row in batch.to_pylist():
            if open_ and row["conv_id"] != now:
                out.append({"conv_id": now, **report, "repaired_sha256": hashed.hexdigest()})
                hashed, some = hashlib.sha256(), False
            now, open_ = row["conv_id"], True
            if row["lines"] is not None:
                hashed.update((b"\n" if some else b"") + row["lines"].encode())
                some = True
            if row["cost"] is not None:
                report = {c: row[c] for c in (*_REPORT, "audit")}
        yield _batch(out, columns)
        out = []
    if open_:
        yield _batch([{"conv_id": now, **report, "repaired_sha256": hashed.hexdigest()}], columns)


def damaged(conversations: DataFrame) -> DataFrame:
    """turns for repair: rows dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def reported(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: its faults, its repair and a digest of what it is now."""
    stage = Stage(conversations.sparkSession, "reported")
    found = stage.keep(repair(damaged(conversations)), "repaired")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = found.where("part is null").select("conv_id", *_REPORT, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    long_ = found.where("part is not null").select("conv_id", "part", *_REPORT, "audit", F.when(F.size("turns") > 0, lines).alias("lines"))
    digests = long_.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_long_digests, f"conv_id {kind}, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")
    gaps = F.coalesce(F.least(F.expr("cast(high as decimal(38,0)) - low + 1 - distinct"), F.lit(MAX_LONG)).cast("long"), F.lit(0).cast("long"))
    return whole.union(digests).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return reported(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
