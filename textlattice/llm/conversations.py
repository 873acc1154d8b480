"""Repair of a conversation's structure by a dynamic programme over the rows that stay.

A conversation should read `(s?(ua)+)?` in its roles' initials. Rows are kept, reroled to user or assistant, or deleted;
empty rows of a user or an assistant can be inserted anywhere. Blank and repeated rows have to go.

1. Rows without their texts (a digest stands for one) are put in order by one range partitioning, so that a conversation
   of any number of rows is dealt over many tasks, and numbered. What was seen earlier comes from a grouping by
   (conversation, role, digest), whose smallest number is the first; it meets the rows by number, never by a hot key.
2. Each aligned run of SEGMENT numbers of a conversation is one short word of codes. For every state that can stand before
   it (no row yet, system, user, assistant) the programme runs over its rows: the cheapest way that retains row j in a
   role is the row's own price, the inserts that the pair of roles needs, the sum of deletions up to j, and the running
   minimum, for each earlier role, of (cost - sum of deletions up to that row). Equal costs are decided by the audits:
   two audits over the same rows that both end with a row's letter are never beginnings of one another, so their order
   stays whatever follows, and the running minima may decide at once.
3. A segment's summary is 16 costs and the order of the audits. A conversation's summaries are composed one after the
   other (one small row for each SEGMENT rows), and each segment learns the states in which it is entered and left.
4. The chosen audits go to the texts in a single shuffle, in which they are sorted in just before their rows; the
   repaired rows, or the digest of them, come out of one pass that holds one row at a time. SHA-256 is a chain, so the
   digest of one conversation is the work of one task, however long it is.

Defined results: a null role or text is one space, a null id or turn one space in the key of the damage; a null id is a
conversation of its own; a null turn comes first and counts in no gap; rows of one turn come by role, then by the SHA-256
of their text; a role is known by its first letter, and one with another letter (or none) can't be kept; a conversation
without rows has zeros and an empty audit; rows of equal id and turn are all rows; a text of any length is handled whole;
columns of other names are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.llm.common import materialise

#: Numbers of a segment, as a power of two.
SEGMENT = 8
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
BY_LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Rows to insert between two retained roles (none: the second can't follow), and after the last one.
INSERTS: dict[int, dict[int, int]] = {START: {SYSTEM: 0, USER: 0, ASSISTANT: 1}, SYSTEM: {USER: 0, ASSISTANT: 1}, USER: {USER: 1, ASSISTANT: 0}, ASSISTANT: {USER: 0, ASSISTANT: 1}}
AT_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60
_ORDER = ["conv_id", "turn", "role", "digest", "copy"]
_HAS_WORD, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def damaged(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. The damage of the contract, by the CRC of `conv_id:turn`; `copy` tells repeated rows apart."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def whole(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form of `damaged`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.lit(0).alias("copy"))


def _digest() -> Column:
    return F.sha2("text", 256)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in order, without their texts, with a number that grows in this order. Written once, so that numbers stay."""
    letter = F.substring("role", 1, 1)
    kind = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    light = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "copy", kind.alias("kind"), (~F.col("text").rlike(_HAS_WORD)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("cut"))
    light = light.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return materialise(light.withColumn("number", F.monotonically_increasing_id()), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """turns with `fault`: 0 none, 1 truncated, 2 blank, 3 duplicate; the first that holds of blank, duplicate, truncated."""
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), 2).when(F.col("is_first").isNull(), 3).when(F.col("cut"), 1).otherwise(0)
    return turns.join(first, "number", "left").withColumn("fault", fault)


def statistics(turns: DataFrame) -> DataFrame:
    """One row per conversation that has rows: gaps and the counts of faults."""
    each = turns.groupBy("conv_id", "turn").agg(*[F.count(F.when(F.col("fault") == k, 1)).alias(c) for k, c in ((2, "blank"), (3, "duplicate"), (1, "truncated"))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return each.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def segments(turns: DataFrame, bits: int = SEGMENT) -> DataFrame:
    """One row per conversation and aligned run of numbers: its first row's number and place in order, and two letters for each row."""
    code = F.struct("number", F.concat("kind", F.col("fault").cast("string")).alias("code"))
    first = F.min_by(F.struct("turn", "role", "digest", "copy"), "number").alias("at")
    out = turns.groupBy("conv_id", F.shiftright("number", bits).alias("run")).agg(F.min("number").alias("segment"), first, F.array_sort(F.collect_list(code)).alias("codes"))
    return out.select("conv_id", "segment", "at.*", F.array_join(F.transform("codes", lambda c: c["code"]), "").alias("codes"))


@functools.lru_cache(maxsize=1 << 16)
def cheapest(codes: str, enter: int) -> tuple[tuple[int, str], ...]:
    """For each state after the rows of codes, entered in a state: the least cost and its least audit."""
    deleted, n = 0, len(codes) // 2
    low: dict[int, tuple[int, str, int]] = {enter: (0, "", 0)}  # by role: cost - deletions, audit, rows that it covers

    for j in range(n):
        kind, fault = codes[2 * j], codes[2 * j + 1]
        ways: list[tuple[int, int, str]] = []
        if fault in "01":
            own = CUT if fault == "1" else 0
            ways = [(USER, own + REROLE, "R"), (ASSISTANT, own + REROLE, "R")]
            if kind in BY_LETTER:
                ways.insert(0, (BY_LETTER[kind], own + KEEP, "K"))
        new: dict[int, tuple[int, str]] = {}
        for role, price, letter in ways:
            for before, (cost, audit, covered) in low.items():
                inserts = INSERTS[before].get(role)
                if inserts is None:
                    continue
                total = cost + deleted + INSERT * inserts + price
                if role not in new or total <= new[role][0]:
                    way = (total, f"{audit}{'D' * (j - covered)}{'I' * inserts}{letter}")
                    new[role] = min(way, new.get(role, way))
        deleted += DELETE
        for role, (total, audit) in new.items():
            held = low.get(role)
            if held is None or (total - deleted, audit) < (held[0], held[1] + "D" * (j + 1 - held[2])):
                low[role] = (total - deleted, audit, j + 1)
    out = ((low[s][0] + deleted, low[s][1] + "D" * (n - low[s][2])) if s in low else (NEVER, "") for s in STATES)
    return tuple(out)


def summarised(parts: DataFrame) -> DataFrame:
    """Costs and audits' order of each segment for each pair of states; its first and last kind and its illegal pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for codes in b.column(2).to_pylist():
                ways = [cheapest(codes, s) for s in STATES]
                orders = [sorted(STATES, key=lambda s, w=w: w[s][1]) for w in ways]
                kinds = codes[::2]
                illegal = sum(kinds[k : k + 2] not in LEGAL for k in range(len(kinds) - 1))
                out.append((kinds[0], kinds[-1], illegal, [c for w in ways for c, _ in w], [o.index(s) for o in orders for s in STATES]))
            types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["conv_id", "segment", "first", "last", "illegal", "costs", "ranks"])

    rows = parts.select("conv_id", "segment", "codes")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, segment long, first string, last string, illegal long, costs array<long>, ranks array<int>")


class Composer:
    """Composes the summaries of one conversation; holds four small numbers for each segment."""

    def __init__(self) -> None:
        self.cost, self.rank = [0, NEVER, NEVER, NEVER], [0, 1, 2, 3]
        self.segments: list[int] = []
        self.back: list[bytes] = []
        self.illegal, self.last = 0, ""

    def add(self, segment: int, first: str, last: str, illegal: int, costs: list[int], ranks: list[int]) -> None:
        best = [min((min(self.cost[q] + costs[4 * q + s], NEVER), self.rank[q], q) for q in STATES) for s in STATES]
        order = sorted(STATES, key=lambda s: (best[s][1], ranks[4 * best[s][2] + s]))
        self.cost, self.rank = [b[0] for b in best], [order.index(s) for s in STATES]
        self.segments.append(segment)
        self.back.append(bytes(b[2] for b in best))
        self.illegal += illegal + (bool(self.last) and self.last + first not in LEGAL)
        self.last = last

    def paths(self) -> list[tuple[int, int, int, int, int]]:
        """segment, the states before and after it, and on the last one the whole cost and illegal pairs (-1 elsewhere)."""
        total, _, state = min((self.cost[s] + INSERT * AT_END[s], self.rank[s], s) for s in STATES)
        out = []
        for segment, back in zip(reversed(self.segments), reversed(self.back), strict=True):
            out.append((segment, back[state], state, total if not out else -1, self.illegal if not out else -1))
            state = back[state]
        return out


def composed(summaries: DataFrame) -> DataFrame:
    """segment, enter, leave, cost, illegal: how the cheapest repair of its conversation passes each segment."""
    names = ["segment", "enter", "leave", "cost", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: Any = None
        work: Composer | None = None
        done: list[tuple[int, ...]] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=names)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if work is None or row[0] != conv:
                    done += work.paths() if work else []
                    conv, work = row[0], Composer()
                work.add(*row[1:])
            if done:
                yield table()
                done = []
        done = work.paths() if work else []
        if done:
            yield table()

    dealt = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def chosen(parts: DataFrame, paths: DataFrame) -> DataFrame:
    """Segments with the audit of their part of the cheapest repair, the end's inserts on the last one."""

    @F.pandas_udf("string")
    def audit(codes, enter, leave):  # noqa: ANN001, ANN202
        return codes.__class__([cheapest(c, q)[s][1] for c, q, s in zip(codes, enter, leave, strict=True)])

    end = F.element_at(F.array(*[F.lit("I" * AT_END[s]) for s in STATES]), (F.col("leave") + 1).cast("int"))
    text = F.concat(audit("codes", "enter", "leave"), F.when(F.col("cost") >= 0, end).otherwise(""))
    return parts.join(paths, "segment").select(*_ORDER, "segment", text.alias("audit"), "cost", "illegal")


class Walker:
    """Follows audits over the rows of a conversation, one row at a time."""

    def __init__(self) -> None:
        self.state, self.audit, self.at, self.tail = START, "", 0, 0
        self.audits: deque[str] = deque()

    def segment(self, audit: str) -> None:
        """Equal rows on both sides of a segment's edge sort after both audits, so that audits may have to wait."""
        self.audits.append(audit)

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what is inserted before the row, of the row unless it goes, and of the end's inserts."""
        if self.at == len(self.audit):
            self.audit, self.at = self.audits.popleft(), 0
            self.tail = len(self.audit.rstrip("I"))
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, self._next(role if edit == "K" else None), text
        if self.at == self.tail:
            yield from self._inserted()

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield "I", self._next(None), ""

    def _next(self, role: str | None) -> str:
        self.state = BY_LETTER[role[0]] if role else ASSISTANT if self.state == USER else USER
        return role or ROLE[self.state]


def with_audits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts, and each segment's audit just before its first row; a conversation's rows in one task, in order."""
    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    texts = rows.withColumn("digest", _digest()).select(*_ORDER, F.lit(1).alias("kind"), "text", *none(("audit", "string"), ("cost", "long"), ("illegal", "long"), ("segment", "long")))
    audits = edits.select(*_ORDER, F.lit(0).alias("kind"), *none(("text", "string")), "audit", "cost", "illegal", "segment")
    both = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions(*_ORDER, "kind", "segment")
    return both.select("conv_id", "kind", "role", "text", "audit", "cost", "illegal")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, bool, tuple[str, int, int] | None, list[tuple[str, str, str]]]]:
    """For each row: its conversation, whether that is a new one, a segment's (audit, cost, illegal) or a row's repaired rows."""
    conv: Any = None
    walker: Walker | None = None
    for b in batches:
        for c, kind, role, text, audit, cost, illegal in zip(*[x.to_pylist() for x in b.columns], strict=True):
            new = walker is None or c != conv
            if new:
                conv, walker = c, Walker()
            if kind == 0:
                walker.segment(audit)
            yield c, new, (audit, cost, illegal) if kind == 0 else None, [] if kind == 0 else list(walker.row(role, text))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of all repaired conversations: conv_id, place (from 0), edit, role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size, kinds = [], 0, 0, []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield b

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])

        for conv, new, _, lines in _walked(seen()):
            place = 0 if new else place
            for line in lines:
                out.append((conv, place, *line))
                place, size = place + 1, size + len(line[2])
            if size > 1 << 22 or len(out) > 10_000:
                yield table()
                out, size = [], 0
        if out:
            yield table()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return with_audits(rows, edits).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation with rows: illegal, cost, audit, repaired_sha256. Holds a conversation's audit, not its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held: dict[str, Any] = {}
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield b

        def close() -> None:
            if held:
                done.append((held["conv"], held["illegal"], held["cost"], "".join(held["audits"]), held["sha"].hexdigest()))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

        for conv, new, segment, lines in _walked(seen()):
            if new:
                close()
                held = {"conv": conv, "audits": [], "sha": hashlib.sha256(), "any": False}
            if segment:
                held["audits"].append(segment[0])
                if segment[1] >= 0:
                    held["cost"], held["illegal"] = segment[1:]
            for _, role, text in lines:
                held["sha"].update((("\n" if held["any"] else "") + f"{role}:{text}").encode())
                held["any"] = True
            if len(done) >= 5000:
                yield table()
                done.clear()
        close()
        if done:
            yield table()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return with_audits(rows, edits).mapInArrow(run, f"conv_id {kind}, illegal long, cost long, audit string, repaired_sha256 string")


def plan(rows: DataFrame, bits: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """rows: as from `damaged` or `whole`. Statistics of each conversation, and the chosen audits of its segments."""
    turns = materialise(with_faults(numbered(rows)), "faults")
    parts = materialise(segments(turns, bits), "segments")
    return statistics(turns), chosen(parts, composed(summarised(parts)))


def report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True, bits: int = SEGMENT) -> DataFrame:
    """One row per conversation of the table, those without rows after the damage too."""
    named = conversations.select(*[F.col(c).alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    rows = damaged(named) if damage else whole(named)
    stats, edits = plan(rows, bits)
    out = named.select(F.col("conv_id").alias("id")).distinct()
    for part in (stats, digests(rows, edits)):
        names = [c for c in part.columns if c != "conv_id"]
        out = out.join(part.withColumnRenamed("conv_id", "own"), F.col("id").eqNullSafe(F.col("own")), "left").select(*[c for c in out.columns], *names)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
