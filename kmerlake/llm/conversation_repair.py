"""Repair of conversations by weighted finite-state composition.

Three machines are composed, and only the states that a conversation reaches are ever built:

* the input acceptor, a chain with one arc for each row. A row is one of nine signs: the initial of its role (s, u, a or o for
  others), a capital if its text is cut short, or D if it must go, being blank or a repetition;
* the edit transducer: K keeps a row (cost 0), R gives it role user or assistant (2), D deletes it (3), I inserts a row of
  either role (2); a row that is cut short and stays costs 1 more;
* the grammar acceptor of role initials, (s?(ua)+)?, with the states START, SYSTEM, USER and ASSISTANT.

Weights are pairs (cost, string of edits), compared in this order, and added up along a path. The composition is acyclic from
row to row, since insertions belong to the edit that follows them; so the shortest path is found in topological order.
Strings of two paths over the same rows end in an edit of a row, so that neither begins the other, and the lesser stays
lesser whatever follows. Hence only the order of the four states' strings matters, and what the four weights are but for a
common cost takes few values: steps from such a profile by a sign are kept, and a row costs a look in that table.

Rows are put in order by ranges, so that a long conversation lies in several tasks. Each task finds the weights of its stretch
from each state to each state; stretches of a conversation, one row each, are then composed in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: Where each state goes by a role's initial.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that a new or changed row gets in each state, and (insertions, cost) by which a conversation may end there.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}

Profile = tuple  # of (cost, place of the string) or None for each state


class Composition:
    """Steps of the composed machine, built as they are met."""

    def __init__(self):
        self.arcs: dict[tuple[int, str], list[tuple[int, int, str]]] = {}
        self.steps: dict[tuple[Profile, str], tuple[Profile, int, tuple]] = {}

    def arcs_from(self, state: int, sign: str) -> list[tuple[int, int, str]]:
        """(to, cost, edits): insertions, of which two reach every state, and an edit of the row."""
        if (state, sign) not in self.arcs:
            found, at, cost, edits = [], state, 0, ""
            for _ in range(3):
                found.append((at, cost + DELETE, edits + "D"))
                if sign != "D":
                    more = CUT_SHORT if sign.isupper() else 0
                    if (to := GRAMMAR[at].get(sign.lower())) is not None:
                        found.append((to, cost + KEEP + more, edits + "K"))
                    found.append((GRAMMAR[at][NEXT_ROLE[at][0]], cost + REROLE + more, edits + "R"))
                at, cost, edits = GRAMMAR[at][NEXT_ROLE[at][0]], cost + INSERT, edits + "I"
            self.arcs[state, sign] = found
        return self.arcs[state, sign]

    def step(self, profile: Profile, sign: str) -> tuple[Profile, int, tuple]:
        """(next profile, cost of all of it, for each state the state before and the edits) by one sign."""
        if (profile, sign) not in self.steps:
            paths = ((to, (w[0] + cost, w[1], edits, state)) for state, w in enumerate(profile) if w for to, cost, edits in self.arcs_from(state, sign))
            self.steps[profile, sign] = chosen(paths)
        return self.steps[profile, sign]

    def weights(self, signs: str, entry: int) -> dict[int, tuple[int, str]]:
        """For each state that is reached from entry by signs, the least cost and string."""
        profile, total, back = tuple((0, 0) if s == entry else None for s in range(4)), 0, []
        for sign in signs:
            profile, cost, origin = self.step(profile, sign)
            total += cost
            back.append(origin)
        out = {}
        for state, w in enumerate(profile):
            if w:
                at, edits = state, []
                for origin in reversed(back):
                    at, own = origin[at]
                    edits.append(own)
                out[state] = total + w[0], "".join(reversed(edits))
        return out


def chosen(paths) -> tuple[Profile, int, tuple]:
    """From (to, (cost, place of the string before, edits, state before)): the least for each state, as step() returns it."""
    best: list = [None] * 4
    for to, path in paths:
        if best[to] is None or path < best[to]:
            best[to] = path
    base = min(p[0] for p in best if p)
    places = {x: i for i, x in enumerate(sorted({p[1:3] for p in best if p}))}
    return tuple((p[0] - base, places[p[1:3]]) if p else None for p in best), base, tuple((p[3], p[2]) if p else None for p in best)


def composed(stretches: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost of stretches (by entry and exit state) one after another, and of each its entry state and edits."""
    profile: Profile = ((0, 0), None, None, None)
    total, back = 0, []
    for own in stretches:
        paths = ((to, (w[0] + cost, w[1], edits, state)) for state, w in enumerate(profile) if w for to, (cost, edits) in own.get(state, {}).items())
        profile, cost, origin = chosen(paths)
        total += cost
        back.append(origin)
    cost, _, tail, at = min((w[0] + INSERT * len(ENDS[s]), w[1], ENDS[s], s) for s, w in enumerate(profile) if w)
    out = []
    for origin in reversed(back):
        at, edits = origin[at]
        out.append((at, edits))
    out.reverse()
    if out:
        out[-1] = out[-1][0], out[-1][1] + tail
    return total + cost, out


# ---------------------------------------------------------------- rows in order


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of every row, some damaged by a checksum of conv_id and turn; nulls count as one space there and in role and text."""
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select(
        rows["conv_id"].cast("bigint").alias("conv_id"), rows["turn"].cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


KEY = ["has_conv", "conv", "has_turn", "turn", "role"]


def in_order(rows: DataFrame) -> DataFrame:
    """KEY, text, n, sign, at of rows (conv_id, turn, role, text, copies): equal rows as one of n copies, in order inside tasks.

    at: a number that orders all rows, by conversation, turn (nulls first), role and text; its bits from 33 on tell the task.
    A row without copies only tells that its conversation is there.
    """
    there = F.col("copies") > 0
    keyed = rows.select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), (there & F.col("turn").isNotNull()).alias("has_turn"),
        F.when(there, F.coalesce("turn", F.lit(0))).otherwise(0).alias("turn"), F.when(there, F.col("role")).otherwise("").alias("role"),
        F.when(there, F.col("text")).otherwise("").alias("text"), "copies",
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    alike = keyed.groupBy(*KEY, "digest").agg(F.sum("copies").alias("n"), F.max("text").alias("text"))
    first = alike.groupBy("has_conv", "conv", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("t"))
    first = first.select("has_conv", "conv", "t.has_turn", "t.turn", "role", "digest", F.lit(True).alias("first"))
    stem = F.rtrim("text", F.lit(BLANKS))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    sign = F.when((stem == "") | F.col("first").isNull(), "D").when(F.right(stem, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    found = alike.join(first, [*KEY, "digest"], "left")
    found = found.select(*KEY, "text", "n", sign.alias("sign"), initial.alias("initial"), (stem == "").alias("blank"))
    order = [*KEY, "text"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


STATE = "state int, at_end int, cost bigint, edits string"
STRETCH = f"n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint, weights array<struct<{STATE.replace(' ', ':').replace(',:', ',')}>>"
ROWS = "has_conv boolean, conv bigint, at bigint, role string, text string, n bigint"


class Stretch:
    """What a task knows of the rows of one conversation that it has: counts, and weights from the states in which it may be entered."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = ""
        self.low = self.high = None
        self.signs: list[str] = []

    def add(self, turn: int | None, n: int, sign: str, initial: str, blank: bool) -> None:
        if turn is not None and n:
            self.low, self.turns = (turn, 1) if self.low is None else (self.low, self.turns + (turn != self.high))
            self.high = turn
        if not n:
            return
        self.n += n
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n if sign == "D" else n - 1
        self.truncated += sign in "SUAO"
        self.illegal += n - 1 + (bool(self.tail) and self.tail + initial not in LEGAL)
        self.head, self.tail = self.head or initial, initial
        self.signs.append(sign + "D" * (n - 1))

    def row(self, machine: Composition, entries: range) -> dict:
        signs = "".join(self.signs)
        weights = [(entry, to, cost, edits) for entry in entries for to, (cost, edits) in machine.weights(signs, entry).items()]
        return {c: getattr(self, c) for c in ("n", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns")} | {
            "weights": [dict(zip(("state", "at_end", "cost", "edits"), w, strict=True)) for w in weights]
        }


def stretched(rows: DataFrame) -> DataFrame:
    """Rows of in_order(), and after the rows of each conversation in a task one that has its stretch."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    kind = pa.struct([("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("weights", pa.list_(pa.struct([("state", pa.int32()), ("at_end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])
    blank_row = {"role": pa.string(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, own, last, first = Composition(), None, Stretch(), 0, True

        def ended(done: list) -> pa.RecordBatch:
            convs, ats, said = [d[0] for d in done], [d[1] for d in done], [d[2] for d in done]
            columns = [pa.array([c[0] for c in convs], pa.bool_()), pa.array([c[1] for c in convs], pa.int64()), pa.array(ats, pa.int64()), *(pa.nulls(len(done), t) for t in blank_row.values()), pa.nulls(len(done), pa.int64()), pa.array(said, kind)]
            return pa.RecordBatch.from_arrays(columns, [*names, "stretch"])

        for batch in batches:
            done = []
            columns = ("has_conv", "conv", "has_turn", "turn", "n", "sign", "initial", "blank", "at")
            for has, conv, has_turn, turn, n, sign, initial, blank, at in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (has, conv) != now:
                    if now:
                        done.append((now, last, own.row(machine, range(4) if first else range(1))))
                        first = False
                    now, own = (has, conv), Stretch()
                own.add(turn if has_turn else None, n, sign, initial, blank)
                last = at
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.nulls(len(batch), kind)], [*names, "stretch"])
            if done:
                yield ended(done)
        if now:
            yield ended([(now, last, own.row(machine, range(4) if first else range(1)))])

    return rows.select("*").mapInArrow(run, f"{ROWS}, stretch struct<{STRETCH.replace(' ', ':').replace(',:', ',')}>")


# ---------------------------------------------------------------- conversations

FOUND = "has_conv boolean, conv bigint, part bigint, state int, edits string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def conversations(rows: DataFrame) -> DataFrame:
    """FOUND: for each stretch of a conversation its part (the task's number), entry state and edits; on the first one the conversation's counts, cost and audit.

    A conversation's stretches, one for each task that has rows of it, meet in one group.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]

    def solve(stretches: list[tuple[int, dict]]) -> list[tuple]:
        counts = {c: sum(s[c] for _, s in stretches) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        tail, low, high = "", None, None
        for _, s in stretches:
            counts["illegal"] += bool(tail and s["head"]) and tail + s["head"] not in LEGAL
            tail = s["tail"] or tail
            if s["low"] is not None:
                counts["turns"] -= s["low"] == high
                low, high = s["low"] if low is None else low, s["high"]
        by_state = []
        for _, s in stretches:
            weights: dict[int, dict] = {}
            for w in s["weights"]:
                weights.setdefault(w["state"], {})[w["at_end"]] = w["cost"], w["edits"]
            by_state.append(weights)
        cost, edits = composed(by_state)
        gaps = high - low + 1 - counts["turns"] if low is not None else 0
        said = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, "".join(e for _, e in edits))
        return [(part, state, own, *(said if i == 0 else (None,) * 7)) for i, ((part, _), (state, own)) in enumerate(zip(stretches, edits, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6, pa.string()]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for has, conv, part, stretch in zip(*(batch.column(c).to_pylist() for c in ("has_conv", "conv", "part", "stretch")), strict=True):
                if (has, conv) != now:
                    if now:
                        out += [(*now, *x) for x in solve(held)]
                    now, held = (has, conv), []
                held.append((part, stretch))
            if out:
                yield batch_of(out)
        if now:
            yield batch_of([(*now, *x) for x in solve(held)])

    own = rows.where("stretch is not null").select("has_conv", "conv", F.shiftright("at", 33).alias("part"), "stretch")
    return own.repartition("has_conv", "conv").sortWithinPartitions("has_conv", "conv", "part").mapInArrow(run, FOUND)


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(conversation, repaired rows (at, edit, role, text)) from a sorted stream: before the rows of a stretch comes its state and edits."""
    now, part, state, edits, i, last = None, None, START, "", 0, 0

    def inserted() -> list[tuple]:
        nonlocal state, i
        out = []
        while i < len(edits) and edits[i] == "I":
            out.append((last, "I", NEXT_ROLE[state], ""))
            state, i = GRAMMAR[state][NEXT_ROLE[state][0]], i + 1
        return out

    for batch in batches:
        columns = ("has_conv", "conv", "part", "at", "state", "edits", "role", "text", "n")
        for has, conv, own_part, at, own_state, own_edits, role, text, n in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if own_edits is not None:
                if now is not None:
                    yield now, inserted()
                now, part, state, edits, i = (has, conv), own_part, own_state, own_edits, 0
                yield now, []
                continue
            assert (has, conv, own_part) == (*now, part)
            last, out = at, []
            for _ in range(n):
                out += inserted()
                edit = edits[i]
                i += 1
                if edit == "R":
                    role = NEXT_ROLE[state]
                if edit != "D":
                    state = GRAMMAR[state][role[0]]
                    out.append((at, edit, role, text))
            yield now, out
    if now is not None:
        yield now, inserted()


def stream(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Edits of stretches and rows, by conversation, part and place; a conversation's, or with part a stretch's, in one task, whose memory does not grow with it."""
    edits = found.select("has_conv", "conv", "part", F.lit(-1).cast("bigint").alias("at"), "state", "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("n"))
    own = rows.where("stretch is null").select("has_conv", "conv", F.shiftright("at", 33).alias("part"), "at", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits"), "role", "text", "n")
    return edits.union(own).repartition(*by).sortWithinPartitions("has_conv", "conv", "part", "at")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, at, sub, edit, role, text: the rows of repaired conversations, in the order of at and sub; stretches are worked on side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = 0
        for (has, conv), out in walked(batches):
            if out:
                places = range(sub, sub + len(out))
                sub += len(out)
                columns = [[conv if has else None] * len(out), [x[0] for x in out], list(places), *([x[c] for x in out] for c in (1, 2, 3))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "at", "sub", "edit", "role", "text"])

    return stream(rows, found, ["has_conv", "conv", "part"]).mapInArrow(run, "conv_id bigint, at bigint, sub bigint, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """has_conv, conv, repaired_sha256 of role:text of repaired rows, joined by line feeds. A digest is one sequence of bytes, so a conversation is streamed through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, begun, done = None, hashlib.sha256(), False, []

        def batch_of() -> pa.RecordBatch:
            columns = [[d[0][0] for d in done], [d[0][1] for d in done], [d[1] for d in done]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.string()), strict=True)], ["has_conv", "conv", "repaired_sha256"])

        for conv, out in walked(batches):
            if conv != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest, begun = conv, hashlib.sha256(), False
                if len(done) == 1000:
                    yield batch_of()
                    done.clear()
            for _, _, role, text in out:
                digest.update(("\n" if begun else "").encode() + f"{role}:{text}".encode())
                begun = True
        if now is not None:
            done.append((now, digest.hexdigest()))
        if done:
            yield batch_of()

    return stream(rows, found, ["has_conv", "conv"]).mapInArrow(run, "has_conv boolean, conv bigint, repaired_sha256 string")


def solved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in order, what conversations() finds) of rows (conv_id, turn, role, text, copies); both are what repaired() and digests() need."""
    ordered = stored(stretched(in_order(rows)), "turns")
    return ordered, stored(conversations(ordered), "edits")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, at, sub, edit, role, text of the cheapest legal form of conversations (conv_id, turn, role, text), rows in order of at and sub.

    Rows of a conversation are in the order of turn (nulls first), role and text. A null conv_id is a conversation of its own;
    null role and text count as one space. Blank rows, and rows whose role and text came before, are deleted. A conversation
    that keeps no row is not returned. An empty table gives no rows; other columns are not read.
    """
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    plain = rows.select(rows["conv_id"].cast("bigint").alias("conv_id"), rows["turn"].cast("bigint").alias("turn"), said("role"), said("text"), F.lit(1).cast("bigint").alias("copies"))
    return repaired(*solved(plain))


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (conv_id, turn, role, text, copies), as repair() treats them.

    A conversation whose rows all have no copies has zeros, an empty audit and the digest of nothing.
    """
    ordered, found = solved(rows)
    said = found.where("audit is not null").join(digests(ordered, found), ["has_conv", "conv"])
    return said.select(F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
