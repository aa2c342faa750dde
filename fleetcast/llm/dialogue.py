"""Repair of the role order of conversations by the auction algorithm for shortest paths.

Edits that turn a conversation into a legal one are paths through a lattice: a node is a number of turns read and
a state of the automaton of ``(s?(ua)+)?``, an arc is an edit with its integer cost. The auction keeps a price per node
and one path from the start. At the path's end it compares the price with the cheapest arc plus the price behind it: if
the price is lower it rises to that value and the path loses its last node (contraction), else the path takes that arc
(extension). When the path arrives, prices satisfy ``price(i) <= cost(i, j) + price(j)`` everywhere with equality along shortest paths; so the
cheapest repairs are the paths of tight arcs that arrive, of which the first in the order of their initials is traced.

The lattice of a long conversation is cut into stretches of 32 turns. A stretch is solved for each pair of entry and exit state; the
results are the arcs of a lattice of stretches, which is cut in the same way, until one stretch is left. So a task
never holds a conversation, and prices stay small, as an auction takes as many steps as prices have to rise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetcast.llm.ranks import ranked
from fleetcast.session import materialize

# Costs of edits, the legal order of roles, and the faults: fixed values of the task.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"

# A turn is one character: its role's initial for a sound turn, the upper case one for a truncated turn, and DEAD for a turn that must go.
OTHER, OTHER_CUT, DEAD, END = ".", ":", "-", "$"
STRETCH = 32
MEMORY = 1 << 16  # lattices a task remembers

Arc = tuple[int, str, int]  # cost, initials, next node


def auction(arcs: Callable[[int], list[Arc]], origin: int, goal: int, price: dict[int, int]) -> int | None:
    """Cost of a shortest path, None if there is none; ``price`` (0 where not named) stays valid for other origins with the same goal.

    Arcs cost nothing or more, and every cycle costs something. Nodes without a way to the goal must not be offered as next nodes.
    """
    path, node = [], origin
    while node != goal:
        best, to = min(((c + price.get(j, 0), j) for c, _, j in arcs(node)), default=(0, None))
        if to is None:
            return None
        if price.get(node, 0) < best:
            price[node] = best
            if path:
                node = path.pop()
        else:
            path.append(node)
            node = to
    return price.get(origin, 0) - price.get(goal, 0)


def tight_path(arcs: Callable[[int], list[Arc]], origin: int, goal: int, price: dict[int, int]) -> str:
    """The first in order of all texts of initials along tight arcs from the origin to the goal."""
    def tight(i: int) -> list[Arc]:
        return [a for a in arcs(i) if price.get(i, 0) == a[0] + price.get(a[2], 0)]

    into: dict[int, list[int]] = {}
    todo, met = [origin], {origin}
    while todo:
        i = todo.pop()
        for _, _, j in tight(i) if i != goal else []:
            into.setdefault(j, []).append(i)
            if j not in met:
                met.add(j)
                todo.append(j)
    arrives, todo = {goal}, [goal]
    while todo:
        for i in into.get(todo.pop(), []):
            if i not in arrives:
                arrives.add(i)
                todo.append(i)
    out, node = [], origin
    while node != goal:
        _, text, node = min((a for a in tight(node) if a[2] in arrives), key=lambda a: a[1])
        out.append(text)
    return "".join(out)


def turn_edits(code: str) -> dict[int, list[tuple[int, str, int]]]:
    """``state -> (cost, initial, next state)`` of the edits of one turn; END is passed in the two states in which a conversation may end."""
    if code == END:
        return {START: [(0, "", START)], ASSISTANT: [(0, "", START)]}
    cut = TRUNCATED if code.isupper() or code == OTHER_CUT else 0
    out: dict[int, list[tuple[int, str, int]]] = {}
    for state in range(STATES):
        out[state] = [(DELETE, "D", state)]
        if code != DEAD:
            if (state, code.lower()) in STEP:
                out[state].append((KEEP + cut, "K", STEP[state, code.lower()]))
            out[state].append((REROLE + cut, "R", INSERTED[state]))  # the role that may stand here
    return out


def solve(layers: list[dict[int, list[tuple[int, str, int]]]], inserts: bool, entries: tuple[int, ...] = tuple(range(STATES))) -> list[tuple[int, int, int, str]]:
    """``(entry, exit, cost, initials)`` of the cheapest way through the layers, for each entry and exit state that a way joins.

    ``inserts`` says that turns may be inserted before each layer's turn.
    """
    n, found = len(layers), []
    reach: list[set[int]] = [set() for _ in range(n + 1)]  # states of a layer from which the wanted exit can be reached

    for leave in range(STATES):
        reach[n] = {leave}
        for k in range(n - 1, -1, -1):
            reach[k] = {s for s, edits in layers[k].items() if any(to in reach[k + 1] for _, _, to in edits)}
            if inserts:
                for _ in range(STATES):
                    reach[k] |= {s for s, to in INSERTED.items() if to in reach[k]}

        def arcs(node: int) -> list[Arc]:
            k, state = divmod(node, STATES)
            out = [(c, t, (k + 1) * STATES + to) for c, t, to in layers[k].get(state, []) if to in reach[k + 1]]
            if inserts and INSERTED[state] in reach[k]:
                out.append((INSERT, "I", k * STATES + INSERTED[state]))
            return out

        price: dict[int, int] = {}
        goal = n * STATES + leave
        for entry in entries:
            if entry in reach[0]:
                cost = auction(arcs, entry, goal, price)
                found.append((entry, leave, cost, tight_path(arcs, entry, goal, price)))
    return found


WAYS = "array<struct<enter:int,leave:int,cost:long,audit:string>>"


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``codes`` of stretches to their ways; equal stretches are solved once."""
    known: dict[tuple[str, bool], list[dict]] = {}
    for batch in batches:
        ways = []
        for codes, first in zip(batch.column("codes").to_pylist(), batch.column("first").to_pylist()):
            if (codes, first) not in known:
                if len(known) >= MEMORY:
                    known.clear()
                entries = (START,) if first else tuple(range(STATES))
                known[codes, first] = [dict(zip(("enter", "leave", "cost", "audit"), w)) for w in solve([turn_edits(c) for c in codes], True, entries)]
            ways.append(known[codes, first])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("stretch"), _ways(ways)], ["conv", "stretch", "ways"])


def _ways(ways: list[list[dict]]) -> pa.Array:
    return pa.array(ways, pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent stretches to the ways through all of them."""
    for batch in batches:
        out = []
        for members in batch.column("members").to_pylist():
            layers = []
            for member in members:
                layer: dict[int, list[tuple[int, str, int]]] = {}
                for w in member["ways"]:
                    layer.setdefault(w["enter"], []).append((w["cost"], w["audit"], w["leave"]))
                layers.append(layer)
            out.append([dict(zip(("enter", "leave", "cost", "audit"), w)) for w in solve(layers, False)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("stretch"), _ways(out)], ["conv", "stretch", "ways"])


def cheapest(turns: DataFrame) -> DataFrame:
    """``(conv, cost, audit)`` of conversations given as ``(conv, at, code)``, END included: the cheapest repair, first in the order of its initials."""
    place = F.floor(F.col("at") / STRETCH)
    codes = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]))
    stretches = turns.groupBy("conv", place.alias("stretch")).agg(codes.alias("codes")).withColumn("first", F.col("stretch") == 0)
    ways = materialize(stretches.mapInArrow(_first_level, f"conv long, stretch long, ways {WAYS}"), "ways")
    while (ways.agg(F.max("stretch")).first()[0] or 0) > 0:
        groups = ways.groupBy("conv", F.floor(F.col("stretch") / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_list(F.struct(F.col("stretch").alias("at"), "ways"))).alias("members"))
        ways = materialize(groups.mapInArrow(_next_level, f"conv long, stretch long, ways {WAYS}"), "ways")
    best = F.filter("ways", lambda w: (w["enter"] == START) & (w["leave"] == START))[0]
    return ways.select("conv", best["cost"].alias("cost"), best["audit"].alias("audit"))


class Walk:
    """An audit along the turns of its conversation: the roles that turns get and that are inserted between them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[str]:
        """Roles of the turns inserted here."""
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._next()

    def role(self, role: str) -> str | None:
        """The role that the next turn gets; None if it is deleted."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        if edit == "R":
            return self._next()
        self.state = STEP[self.state, role[:1]]
        return role

    def _next(self) -> str:
        self.state = INSERTED[self.state]
        return "user" if self.state == USER else "assistant"


class Script:
    """Digest of a repaired conversation, one line at a time."""

    def __init__(self, audit: str):
        self.walk, self.sum, self.joint = Walk(audit), hashlib.sha256(), ""

    def line(self, role: str, text: str) -> None:
        self.sum.update(f"{self.joint}{role}:{text}".encode())
        self.joint = "\n"

    def turn(self, role: str, text: str) -> None:
        self.insert()
        role = self.walk.role(role)
        if role is not None:
            self.line(role, text)

    def insert(self) -> None:
        for role in self.walk.inserted():
            self.line(role, "")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each repaired conversation. Its first row (``at`` -1) has the audit in ``text``; turns follow in order, so one row is held at a time."""
    def done(found: list[tuple[int, Script]]) -> pa.RecordBatch:
        for _, script in found:
            script.insert()
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in found], pa.int64()), pa.array([x.sum.hexdigest() for _, x in found], pa.string())], ["conv", "repaired_sha256"])

    open_ones: list[tuple[int, Script]] = []
    for batch in batches:
        for conv, at, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "at", "role", "text"))):
            if at < 0:
                open_ones.append((conv, Script(text)))
            else:
                open_ones[-1][1].turn(role, text)
        if len(open_ones) > 1:
            yield done(open_ones[:-1])
            del open_ones[:-1]
    if open_ones:
        yield done(open_ones)


def spaced(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` after the damage that a hash of conversation and turn names; ``twin`` numbers repeated ones. NULL role and text are a space."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(spaced("role"))
    twins = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twins).alias("twin"))


def repair(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each distinct ``conv_id`` of ``all_ids``.

    ``rows`` has ``conv_id, turn, role, text`` without NULL roles and texts; turns are ordered by ``turn`` with NULL first, ties by role and text, so
    repeated rows stand side by side and all but the first are duplicates. NULL is a conversation of its own. A role that starts with no
    letter of s, u, a (an empty one too) cannot be kept. Texts of any length are read as a stream. A conversation without rows
    has zeros, an empty audit and the digest of nothing; an empty table gives an empty result. Further columns are not read.
    """
    spark = rows.sparkSession
    ids = materialize(all_ids.select("conv_id").distinct().withColumn("conv", F.monotonically_increasing_id()), "conversations")
    named = ids.withColumnRenamed("conv_id", "__id")
    placed = ranked(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"], "turns").withColumnRenamed("rank", "at")
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    turns = materialize(placed.join(named, placed["conv_id"].eqNullSafe(named["__id"])).select(
        "conv", "at", "turn", "role", "text", content.alias("content"), last.alias("last")), "placed-turns")
    firsts = turns.groupBy("conv", "content").agg(F.min("at").alias("first_at"))
    facts = turns.select("conv", "at", "turn", "role", "content", "last").join(firsts, ["conv", "content"])
    fault = F.when(F.col("last") == "", "blank").when(F.col("at") > F.col("first_at"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(OTHER)
    code = F.when(F.col("fault").isin("blank", "duplicate"), DEAD).when(F.col("fault") == "truncated", F.when(F.col("initial") == OTHER, OTHER_CUT).otherwise(F.upper("initial"))).otherwise(F.col("initial"))
    facts = facts.select("conv", "at", "turn", initial.alias("initial"), fault.alias("fault")).withColumn("code", code)
    facts = materialize(facts, "turn-faults")

    def count(name: str) -> Column:
        return F.count(F.when(F.col("fault") == name, 1)).alias(name)

    sums = facts.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), count("blank"), count("duplicate"), count("truncated"), F.count("*").alias("n"))
    turns_seen = facts.filter("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("different"))
    # each initial with the next one: a turn is sent to its own place and to the place before it
    pairs = facts.select("conv", "at", F.col("initial").alias("x"), F.lit(None).cast("string").alias("y")).unionByName(
        facts.filter("at > 0").select("conv", (F.col("at") - 1).alias("at"), F.lit(None).cast("string").alias("x"), F.col("initial").alias("y")))
    pairs = pairs.groupBy("conv", "at").agg(F.concat(F.max("x"), F.max("y")).alias("pair")).filter(F.col("pair").isNotNull() & ~F.col("pair").isin(*LEGAL))
    illegal = pairs.groupBy("conv").agg(F.count("*").alias("illegal"))
    ends = sums.select("conv", F.col("n").alias("at"), F.lit(END).alias("code"))
    best = cheapest(facts.select("conv", "at", "code").unionByName(ends))
    report = materialize(sums.join(turns_seen, "conv", "left").join(illegal, "conv", "left").join(best, "conv"), "repairs")
    heads = report.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = turns.select("conv", "at", "role", "text").unionByName(heads)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    digests = stream.repartition(parts, "conv").sortWithinPartitions("conv", "at").mapInArrow(_digests, "conv long, repaired_sha256 string")

    def number(c: Column | str) -> Column:
        return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0)).cast("long")

    whole = ids.join(report, "conv", "left").join(digests, "conv", "left")
    return whole.select(
        "conv_id", number(F.col("hi") - F.col("lo") + 1 - F.col("different")).alias("gaps"), *[number(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
