"""Repair of conversations: the cheapest edits after which roles are an optional system turn and user-assistant pairs.

Edits form a lattice: a node is a number of rows read and what the kept roles end in. Keep, rerole and delete read a row,
insert reads none. A bidirectional Dijkstra search runs from both ends; when the heaps' smallest costs add up to more than
the best crossing, every crossing of least cost is known, and the one with the least concatenated audit is taken.
The search keeps costs alone, and edits are read off the ways of least cost afterwards, so a turn takes some dozens of
bytes.

Spark deals the work out by conversation. The rows of one come sorted, first without and then with their texts, so that a
task holds only initials and faults of a conversation; texts stream by.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an edit costs, and what an undeleted truncated row costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user's, after an assistant's; which of them may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one turn that may be put in at each state, and the states before it.
PUT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
FAULTS = ("", "blank", "duplicate", "truncated")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _ahead(node: tuple[int, int], initials: list[str], faults: list[int]):
    """edit, cost, next node of all edits from a node."""
    i, q = node
    if i < len(initials):
        yield "D", DELETE, (i + 1, q)
        if faults[i] not in (1, 2):
            more = TRUNCATED if faults[i] == 3 else 0
            if (q, initials[i]) in STEPS:
                yield "K", KEEP + more, (i + 1, STEPS[q, initials[i]])
            yield "R", REROLE + more, (i + 1, PUT[q])
    yield "I", INSERT, (i, PUT[q])


def _back(node: tuple[int, int], initials: list[str], faults: list[int]):
    """edit, cost, node before of all edits to a node."""
    i, q = node
    if i > 0:
        yield "D", DELETE, (i - 1, q)
        if faults[i - 1] not in (1, 2):
            more = TRUNCATED if faults[i - 1] == 3 else 0
            for p in range(4):
                if STEPS.get((p, initials[i - 1])) == q:
                    yield "K", KEEP + more, (i - 1, p)
            for p in BEFORE.get(q, ()):
                yield "R", REROLE + more, (i - 1, p)
    for p in BEFORE.get(q, ()):
        yield "I", INSERT, (i, p)


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """Cost and audit (initials of the edits in order) of the cheapest repair, of several the ASCII-least.

    initials: of the rows' roles; faults: 0 none, 1 blank, 2 duplicate (both must go), 3 truncated.
    """
    n = len(initials)
    # least costs known so far from the start and to the end, by 4 * rows read + state; -1: none
    known = tuple(array("q", [-1]) * (4 * n + 4) for _ in range(2))
    heaps: tuple[list, list] = ([], [])
    best = -1

    def reach(side: int, node: tuple[int, int], cost: int) -> None:
        nonlocal best
        at = 4 * node[0] + node[1]
        if known[side][at] < 0 or cost < known[side][at]:
            known[side][at] = cost
            heapq.heappush(heaps[side], (cost, *node))
            if known[1 - side][at] >= 0 and (best < 0 or cost + known[1 - side][at] < best):
                best = cost + known[1 - side][at]

    reach(0, (0, START), 0)
    for q in ENDS:
        reach(1, (n, q), 0)
    while all(heaps) and (best < 0 or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, q = heapq.heappop(heaps[side])
        if cost == known[side][4 * i + q]:
            for _, price, to in (_ahead, _back)[side]((i, q), initials, faults):
                reach(side, to, cost + price)
    return best, "".join(_least(initials, faults, known, best))


def _least(initials: list[str], faults: list[int], known: tuple[array, array], best: int) -> list[str]:
    """The ASCII-least edits among all ways that cross at the least cost.

    Nodes on such ways are marked from the crossings to both ends. Then the least edit that leads on is taken, from all
    nodes that the edits so far may have come to. Ways of equal cost never continue each other, so the first end is the least.
    """
    ahead, back = known
    size = len(ahead)
    crossings = [x for x in range(size) if ahead[x] >= 0 and back[x] >= 0 and ahead[x] + back[x] == best]
    # costs of other nodes may not be final: marks tell which are, from the start and to the end
    marks = (bytearray(size), bytearray(size))
    for way, costs, on in zip((_back, _ahead), known, marks):
        todo = crossings[:]
        for x in crossings:
            on[x] = 1
        while todo:
            x = todo.pop()
            for _, price, to in way(divmod(x, 4), initials, faults):
                y = 4 * to[0] + to[1]
                if not on[y] and costs[y] >= 0 and costs[y] + price == costs[x]:
                    on[y] = 1
                    todo.append(y)

    def leads_on(u: tuple[int, int], price: int, v: tuple[int, int]) -> bool:
        a, b = 4 * u[0] + u[1], 4 * v[0] + v[1]
        return marks[0][a] and marks[0][b] and ahead[a] + price == ahead[b] or marks[1][a] and marks[1][b] and back[b] + price == back[a]

    now, out = {(0, START)}, []
    while not any(i == len(initials) and q in ENDS for i, q in now):
        steps = [(edit, to) for node in now for edit, price, to in _ahead(node, initials, faults) if leads_on(node, price, to)]
        least = min(edit for edit, _ in steps)
        out.append(least)
        now = {to for edit, to in steps if edit == least}
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows with faults put in by crc32 of `conv_id:turn` modulo 20; nulls count as one space, but for turn's order."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with the edit that repairs them, and the rows put in.

    conversations: conv_id, turn, role, text; more columns are ignored. A null role or text is one space; rows without a conv_id are
    a conversation of their own. Rows are read by turn (null first), equal turns by role and text. A row's first fault counts:
    blank (no character but ASCII white space), duplicate (role and text seen earlier), truncated (its last such
    character is none of . ! ?).

    conv_id, place (long, from 0), turn, was (role; null if put in), fault, edit (Keep, Rerole, Delete or Insert, its initial),
    cost (long), role and text (null if deleted). No rows: no rows.
    """
    id_kind, turn_kind = (dict(conversations.dtypes)[c] for c in ("conv_id", "turn"))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    early = F.col("turn").asc_nulls_first()
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(early)))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("seen") > 1, 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    rows = rows.withColumn("fault", fault).repartition("conv_id")
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy(early, "role", "text", "seen")))
    twice = rows.select("conv_id", "turn", "role", "fault", "seq", F.explode(F.array(F.struct(F.lit(0).alias("pass"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(1).alias("pass"), F.col("text").alias("text")))).alias("p")).select("conv_id", "turn", "role", "fault", "seq", "p.*")
    out = f"conv_id {id_kind}, place long, turn {turn_kind}, was string, fault string, edit string, cost long, role string, text string"

    def run(batches):
        now, reading = object(), True
        initials, faults, state, place, audit = [], [], START, 0, iter(())
        conv, kinds = None, None

        def inserts(made: list):
            nonlocal state, place
            for edit in audit:
                if edit != "I":
                    return edit
                state = PUT[state]
                made.append((conv, place, None, None, "", "I", INSERT, ROLES[state], ""))
                place += 1
            return None

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.int64(), batch.schema.field(1).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            made: list[tuple] = []
            for next_conv, turn, role, fault, second, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))):
                if not second and (not reading or next_conv != now):
                    inserts(made)  # those at the end of the conversation before
                    now, reading, initials, faults = next_conv, True, [], []
                if not second:
                    initials.append(role[:1])
                    faults.append(fault)
                    continue
                if reading:
                    reading, state, place, conv = False, START, 0, now
                    audit = iter(cheapest(initials, faults)[1])
                edit = inserts(made)
                more = TRUNCATED if fault == 3 and edit != "D" else 0
                if edit == "D":
                    made.append((conv, place, turn, role, FAULTS[fault], "D", DELETE, None, None))
                else:
                    state = STEPS[state, role[:1]] if edit == "K" else PUT[state]
                    made.append((conv, place, turn, role, FAULTS[fault], edit, (KEEP if edit == "K" else REROLE) + more, role if edit == "K" else ROLES[state], text))
                place += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [f.split(" ")[0] for f in out.split(", ")])
        made = []
        inserts(made)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [f.split(" ")[0] for f in out.split(", ")])

    return twice.sortWithinPartitions("conv_id", "pass", "seq").mapInArrow(run, out)


def digest(rows: DataFrame) -> DataFrame:
    """repaired()'s rows as one row a conversation: counts of gaps, faults and illegal neighbours, cost, audit, and a hash of what is left."""
    id_kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        now, held, kind = None, None, None

        def row():
            turns = held["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (now, gaps, *(held[f] for f in FAULTS[1:]), held["illegal"], held["cost"], "".join(held["audit"]), held["sha"].hexdigest())

        def out(found):
            kinds = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        for batch in batches:
            found, kind = [], batch.schema.field(0).type
            for conv, place, turn, was, fault, edit, cost, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    if held:
                        found.append(row())
                    now, held = conv, dict.fromkeys(FAULTS, 0) | {"illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "turns": None, "last": None, "any": False}
                held[fault] += 1
                held["cost"] += cost
                held["audit"].append(edit)
                if was is not None:
                    held["illegal"] += held["last"] is not None and held["last"] + was[:1] not in LEGAL
                    held["last"] = was[:1]
                if turn is not None:  # turns come in order
                    first, last, many = held["turns"] or (turn, None, 0)
                    held["turns"] = (first, turn, many + (turn != last))
                if edit != "D":
                    held["sha"].update(f"{chr(10) * held['any']}{role}:{text}".encode())
                    held["any"] = True
            if found:
                yield out(found)
        if held:
            yield out([row()])

    picked = rows.select("conv_id", "place", "turn", "was", "fault", "edit", "cost", "role", "text")
    schema = f"conv_id {id_kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string"
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """digest() of the damaged conversations, with a row of zeros for those that lost all their rows."""
    found = digest(repaired(damaged(conversations)))
    known = conversations.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("rows"))
    out = known.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
