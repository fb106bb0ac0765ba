"""Repair of conversations: layers of grammar states by cost over the turns, the first accepting layer and its least trace."""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS, stored, tidy

SPACE = r"\x20\x09-\x0D"
BLANK, DUPLICATE, TRUNCATED, DROPPED = 1, 2, 3, 16
#: Grammar `(s?(ua)+)?`: nothing read, system read, user read, assistant read. Nothing and assistant accept.
START, SYSTEM, USER, ASSISTANT = range(4)
#: In every state but for a leading system turn the role that may come next is fixed, and so is the state behind it.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "-sua"
#: Layers kept over the lowest one that is not empty. From any state an accepting end costs at most 7 more than from the cheapest:
#: two insertions or one deletion make up for any other state.
LAYERS = 8
FULL = 0xF


def _before(states: int, initial: int) -> int:
    """Bitset of the states from which a turn of that initial leads into `states`."""
    if initial == 1:
        return 1 << START if states >> SYSTEM & 1 else 0
    if initial == 2:
        return 1 << START | 1 << SYSTEM | 1 << ASSISTANT if states >> USER & 1 else 0
    return 1 << USER if initial == 3 and states >> ASSISTANT & 1 else 0


def _either(states: int) -> int:
    return _before(states, 2) | _before(states, 3)


class Layers:
    """Backward layers: bit s of layer c says that from state s the rest of the turns is accepted at a cost of c or less.

    Layers count from the lowest that is not empty, so few distinct stacks
    exist; a stack and a turn give the stack before that turn, and are
    worked out once.
    """

    def __init__(self):
        self.stacks: list[tuple[int, ...]] = []
        self.costs: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        ends = [1 << START | 1 << ASSISTANT] * LAYERS
        self.end = self._number(self._inserted(ends))

    @staticmethod
    def _inserted(layers: list[int]) -> list[int]:
        for c in range(2, len(layers)):
            layers[c] |= _either(layers[c - 2])
        return layers

    def _number(self, layers: list[int]) -> int:
        key = tuple(layers[:LAYERS])
        if key not in self.ids:
            self.ids[key] = len(self.stacks)
            self.stacks.append(key)
            self.costs.append(tuple(next(c for c, states in enumerate(key) if states >> s & 1) for s in range(4)))
        return self.ids[key]

    def step(self, stack: int, code: int) -> tuple[int, int]:
        """(stack before a turn of that code, by how much its lowest layer lies above that of `stack`)."""
        if (stack, code) not in self.steps:
            after, initial, fault = self.stacks[stack], code & 3, code >> 2
            more = fault == TRUNCATED

            def layer(c: int) -> int:
                return after[c] if 0 <= c < LAYERS else FULL if c >= LAYERS else 0

            got = [layer(c - 3) for c in range(LAYERS + 4)]
            if fault in (0, TRUNCATED):
                got = [x | _before(layer(c - more), initial) | _either(layer(c - 2 - more)) for c, x in enumerate(got)]
            got = self._inserted(got)
            low = next(c for c, states in enumerate(got) if states)
            self.steps[stack, code] = self._number(got[low:]), low
        return self.steps[stack, code]

    def repaired(self, codes: bytes) -> tuple[int, str, list[int], list[int]]:
        """(cost, least audit, for each turn and for the end: where in the audit its edits begin, in which state)."""
        n = len(codes)
        stacks, base = array("H", bytes(2 * n + 2)), array("q", bytes(8 * n + 8))
        stacks[n] = self.end
        for i in range(n - 1, -1, -1):
            stacks[i], more = self.step(stacks[i + 1], codes[i])
            base[i] = base[i + 1] + more

        def left(i: int, state: int) -> int:
            return base[i] + self.costs[stacks[i]][state]

        state, audit, at, states = START, bytearray(), array("q"), array("B")
        for i in range(n + 1):
            at.append(len(audit))
            states.append(state)
            while True:
                due = left(i, state)
                if i < n and left(i + 1, state) + 3 == due:
                    audit += b"D"
                    break
                if left(i, NEXT[state]) + 2 == due:
                    audit += b"I"
                    state = NEXT[state]
                    continue
                if i == n:
                    break
                initial, more = codes[i] & 3, codes[i] >> 2 == TRUNCATED
                kept = SYSTEM if initial == 1 and state == START else initial if initial in NAME and NEXT[state] == initial else None
                if kept is not None and left(i + 1, kept) + more == due:
                    audit += b"K"
                    state = kept
                else:
                    audit += b"R"
                    state = NEXT[state]
                break
        return left(0, START), audit.decode(), at, states


def damaged(conversations: DataFrame, id_col: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, dropped): the contract's damage, by crc32 of `conv:turn`. Dropped turns stay, marked, so that no conversation is lost."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    own, said = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    deal = F.crc32(name.cast("binary")) % 20
    return (
        conversations.select(F.col(id_col).alias("conv"), F.col(turn).cast("bigint").alias("turn"), own.alias("role"), said.alias("text"), deal.alias("deal"))
        .select(
            "conv",
            "turn",
            F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("deal").isin(0, 1), "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            (F.col("deal") == 0).alias("dropped"),
            F.explode(F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def ordered(turns: DataFrame) -> DataFrame:
    """Turns of all conversations in one order, stored with `seq`, their number in it; the upper bits of seq name the range of the sort.

    Ranges are cut by conversation, turn, role and the beginning of the text,
    so a conversation of any length is dealt over many; no whole text goes to
    the driver for the bounds.
    """
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(0)
    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    sorted_ = turns.repartitionByRange(*key, F.substring("text", 1, 64).asc()).sortWithinPartitions(*key, "text")
    code = F.when(F.col("dropped"), DROPPED).otherwise(initial + 4 * fault)
    return stored(sorted_.select("conv", "turn", "role", "text", code.alias("code"), F.monotonically_increasing_id().alias("seq")), "conversation-turns")


def _range(seq: str = "seq") -> Column:
    return F.shiftright(seq, 33)


def _rows(batches, *columns: str):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield from zip(*[part.column(c).to_pylist() for c in columns])


class _Out:
    """Rows gathered into record batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 0):
        """Takes a row; yields a batch when enough rows or bytes are held."""
        self.rows.append(row)
        self.held += size
        if len(self.rows) >= ROWS or self.held > 1 << 22:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(self.schema)], schema=self.schema)


def _segments(turns: DataFrame) -> DataFrame:
    """(conv, seq, codes, lowest and highest turn, how many turns) of each run of a conversation within a range: a byte a turn.

    A turn is a duplicate unless it is the first of its conversation with its
    role and text; firsts come from a grouping by digests and meet the turns
    by their number in the order.
    """
    conv = turns.schema["conv"].dataType
    said = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    plain = turns.where(F.col("code") < DROPPED).where(F.shiftright("code", 2) != BLANK)
    firsts = plain.groupBy("conv", said.alias("said")).agg(F.min("seq").alias("seq"))
    light = turns.select("seq", "conv", "turn", "code").unionByName(firsts.select("seq", F.lit(None).cast(conv).alias("conv"), F.lit(None).cast("bigint").alias("turn"), F.lit(-1).alias("code")))
    light = light.repartition(_range()).sortWithinPartitions("seq", "code")
    kind = turns.select("conv").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("conv", kind), ("seq", pa.int64()), ("codes", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])

    def run(batches):
        out, first, at, codes, low, high, count, begun = _Out(schema), None, None, bytearray(), None, None, 0, 0
        for seq, conv, turn, code in _rows(batches, "seq", "conv", "turn", "code"):
            if code < 0:
                first = seq
                continue
            if (seq >> 33, conv) != at:
                if at is not None:
                    yield from out.add((at[1], begun, bytes(codes), low, high, count), len(codes))
                at, codes, low, high, count, begun = (seq >> 33, conv), bytearray(), None, None, 0, seq
            if code == DROPPED:
                continue
            if code >> 2 != BLANK and first != seq:
                code = code & 3 | DUPLICATE << 2
            codes.append(code)
            if turn is not None:
                count += turn != high
                low, high = turn if low is None else low, turn
        if at is not None:
            yield from out.add((at[1], begun, bytes(codes), low, high, count))
        yield out.batch()
        tidy()

    return light.mapInArrow(run, f"conv {conv.simpleString()}, seq bigint, codes binary, low bigint, high bigint, turns bigint")


def _solved(segments: DataFrame) -> DataFrame:
    """One row a segment (seq, its part of the audit, the state before it, whether it is all of its conversation) and one a conversation (no seq; totals, audit)."""
    conv = segments.schema["conv"].dataType.simpleString()
    kind = segments.select("conv").limit(0).toArrow().schema.field(0).type
    totals = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv", kind), ("seq", pa.int64()), ("audit", pa.string()), ("state", pa.int32()), ("whole", pa.bool_()), *[(t, pa.int64()) for t in totals]])
    none = (None,) * len(totals)

    def finished(layers: Layers, out: _Out, conv, held: list[tuple]):
        codes = b"".join(h[1] for h in held)
        cost, audit, at, states = layers.repaired(codes)
        row = 0
        for k, (seq, own, *_) in enumerate(held):
            last = k == len(held) - 1
            end = len(audit) if last else at[row + len(own)]
            yield from out.add((conv, seq, audit[at[row] : end], states[row], len(held) == 1, *none), end - at[row])
            row += len(own)
        faults = [codes[i] >> 2 for i in range(len(codes))]
        initials = bytes(c & 3 for c in codes)
        legal = {b"\1\2", b"\2\3", b"\3\2"}
        illegal = sum(initials[i : i + 2] not in legal for i in range(len(initials) - 1))
        dated = [h[2:] for h in held if h[2] is not None]
        distinct = sum(d[2] for d in dated) - sum(a[1] == b[0] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1][1] - dated[0][0] + 1 - distinct if dated else 0
        counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        yield from out.add((conv, None, audit, None, None, gaps, *counts, illegal, cost), len(audit))

    def run(batches):
        layers, out, at, held = Layers(), _Out(schema), None, []
        for conv, *rest in _rows(batches, "conv", "seq", "codes", "low", "high", "turns"):
            if held and conv != at:
                yield from finished(layers, out, at, held)
                held = []
            at = conv
            held.append(tuple(rest))
        if held:
            yield from finished(layers, out, at, held)
        yield out.batch()
        tidy()

    dealt = segments.repartition("conv").sortWithinPartitions("conv", "seq")
    return stored(dealt.mapInArrow(run, f"conv {conv}, seq bigint, audit string, state int, whole boolean, {', '.join(f'{t} bigint' for t in totals)}"), "conversation-audits")


def _lines(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv, seq, sub, sha, lines): the digest of each conversation that stands in one range; of others the lines that every turn leaves, in order."""
    conv = turns.schema["conv"].dataType.simpleString()
    kind = turns.select("conv").limit(0).toArrow().schema.field(0).type
    rows = turns.where(F.col("code") < DROPPED).select("seq", "conv", F.lit(1).alias("is_turn"), "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("boolean").alias("whole"))
    begun = solved.where("seq IS NOT NULL").select("seq", "conv", F.lit(0).alias("is_turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "state", "whole")
    both = rows.unionByName(begun).repartition(_range()).sortWithinPartitions("seq", "is_turn")
    schema = pa.schema([("conv", kind), ("seq", pa.int64()), ("sub", pa.int32()), ("sha", pa.string()), ("lines", pa.string())])

    class Writer:
        """Follows one segment's part of the audit."""

        def __init__(self, conv, seq: int, audit: str, state: int, whole: bool):
            self.conv, self.seq, self.state, self.whole = conv, seq, state, whole
            self.audit, self.k, self.hash, self.any = audit, 0, hashlib.sha256(), False

        def edits(self, role: str | None, text: str | None) -> list[str]:
            """Lines up to and with the next turn, or to the end of the audit."""
            out = []
            while self.k < len(self.audit):
                op = self.audit[self.k]
                self.k += 1
                if op == "I":
                    self.state = NEXT[self.state]
                    out.append(NAME[self.state] + ":")
                    continue
                if op == "K":
                    self.state = INITIALS.index(role[0])
                    out.append(f"{role}:{text}")
                elif op == "R":
                    self.state = NEXT[self.state]
                    out.append(f"{NAME[self.state]}:{text}")
                break
            return out

        def take(self, out: _Out, sub: int, lines: list[str]):
            if self.whole:
                for line in lines:
                    self.hash.update((b"\n" if self.any else b"") + line.encode())
                    self.any = True
            elif lines or sub:
                joined = "\n".join(lines) if lines else None
                yield from out.add((self.conv, self.seq, sub, None, joined), len(joined or ""))

        def finish(self, out: _Out):
            yield from self.take(out, 1, self.edits(None, None))
            if self.whole:
                yield from out.add((self.conv, self.seq, 1, self.hash.hexdigest(), None))

    def run(batches):
        out, now = _Out(schema), None
        for seq, conv, is_turn, role, text, audit, state, whole in _rows(batches, "seq", "conv", "is_turn", "role", "text", "audit", "state", "whole"):
            if not is_turn:
                if now is not None:
                    yield from now.finish(out)
                now = Writer(conv, seq, audit, state, whole)
                continue
            now.seq = seq
            yield from now.take(out, 0, now.edits(role, text))
        if now is not None:
            yield from now.finish(out)
        yield out.batch()
        tidy()

    return stored(both.mapInArrow(run, f"conv {conv}, seq bigint, sub int, sha string, lines string"), "conversation-lines")


def _digests(lines: DataFrame) -> DataFrame:
    """(conv, sha) of conversations over several ranges: a SHA-256 is one chain, so a task reads such a conversation's lines one after the other and holds none."""
    conv = lines.schema["conv"].dataType.simpleString()
    kind = lines.select("conv").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("conv", kind), ("sha", pa.string())])

    def run(batches):
        out, at, now, some = _Out(schema), None, None, False
        for conv, text in _rows(batches, "conv", "lines"):
            if now is None or conv != at:
                if now is not None:
                    yield from out.add((at, now.hexdigest()))
                at, now, some = conv, hashlib.sha256(), False
            if text is not None:
                now.update((b"\n" if some else b"") + text.encode())
                some = True
        if now is not None:
            yield from out.add((at, now.hexdigest()))
        yield out.batch()
        tidy()

    dealt = lines.where("sha IS NULL").select("conv", "seq", "sub", "lines").repartition("conv").sortWithinPartitions("conv", "seq", "sub")
    return dealt.mapInArrow(run, f"conv {conv}, sha string")


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, gaps, blank, duplicate, truncated, illegal, cost, audit), (conv, seq, sub, sha, lines)) of turns (conv, turn, role, text, dropped).

    Turns are sorted once over all conversations; a conversation is split
    wherever the sort splits it.  Per turn one byte (role initial and fault)
    goes to the task that lays the cost layers and traces the audit, which
    is a string of a letter a turn by contract.  Texts go back to their range
    with their part of the audit.
    """
    rows = ordered(turns)
    solved = _solved(_segments(rows))
    return solved.where("seq IS NULL").drop("seq", "state", "whole"), _lines(rows, solved)


def repaired_digests(conversations: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after the contract's damage.

    A null role or text is one space (a turn without text is blank, a turn
    without a role has no legal initial); rows without an id are one
    conversation; turns without a number come first.  Rows that share a turn
    are taken by role, then text; of repeated rows all but the first are
    duplicates.  A conversation with no rows left has zeros, an empty audit
    and the digest of the empty string.  An empty table gives no rows.  Other
    columns are not read.
    """
    totals, lines = repaired(damaged(conversations, id_col, turn, role, text))
    sha = lines.where("sha IS NOT NULL").select("conv", "sha").unionByName(_digests(lines)).select(F.col("conv").alias("_conv"), "sha")
    got = totals.join(sha, F.col("conv").eqNullSafe(F.col("_conv")))
    return got.select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
