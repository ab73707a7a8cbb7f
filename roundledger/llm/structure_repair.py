"""Repair of conversations: the cheapest edits that give a well-formed one.

A well-formed conversation is empty or has an optional system turn, then user
and assistant turns in alternation, ending with an assistant. Rows may be kept,
given another role or deleted, and empty turns inserted. What has been read so
far matters only through one of four states, so the edits of a stretch of rows
are a 4 by 4 matrix of costs and audits (the edits' letters, as ropes), and the
matrix of two stretches is their min-plus product.

Conversations are sequences of few symbols, the role and fault of each row. In
a task, the distinct ones are compressed together by Re-Pair: the commonest pair
of neighbours becomes a rule until none is common. Each rule's matrix is worked
out once, bottom up, and serves every conversation it stands in.

Rows are dealt by ranges of conversation and turn, so a conversation of any
length spreads over tasks; its stretches are joined by their matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundledger.llm.shared import stored

# Costs of edits, and of a row left truncated.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
# What a row's first letter of role and its fault are called in a symbol.
INITIALS = "sua"
FAULTS = ("", "truncated", "blank", "duplicate")
SYMBOLS = (len(INITIALS) + 1) * len(FAULTS)
# States: nothing yet, after a system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The state after a row of an initial, by the state before; others are not allowed.
NEXT = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
# A pair becomes a rule while it stands in this share of the symbols, and twice.
LEAST_SHARE = 1 / 512
# Rows in a batch that a task gives out.
OUT_ROWS = 2048

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_EDIT_SCHEMA = (
    "conv {conv}, row long, at long, edit string, role string, "
    "before array<string>, after array<string>"
)


# Ropes: None, or (length, hash, letter) or (length, hash, left, right).


def leaf(letter: str) -> tuple:
    return 1, ord(letter), letter


def concat(a, b):
    if a is None or b is None:
        return a or b
    return a[0] + b[0], (a[1] * pow(_BASE, b[0], _PRIME) + b[1]) % _PRIME, a, b


def rope_less(a, b) -> bool:
    """Whether rope ``a`` comes before ``b`` in ASCII order; equal parts are skipped."""
    one, other = [a] if a else [], [b] if b else []
    while one and other:
        x, y = one.pop(), other.pop()
        if x is y or x[:2] == y[:2]:
            continue
        if x[0] == y[0] == 1:
            return x[2] < y[2]
        if x[0] >= y[0]:
            one += [x[3], x[2]]
            other.append(y)
        else:
            other += [y[3], y[2]]
            one.append(x)
    return bool(other) and not one


def letters(rope) -> str:
    out, open_ = [], [rope] if rope else []
    while open_:
        x = open_.pop()
        if x[0] == 1:
            out.append(x[2])
        else:
            open_ += [x[3], x[2]]
    return "".join(out)


def rope_of(text: str):
    """A balanced rope."""
    parts = [leaf(c) for c in text]
    while len(parts) > 1:
        parts = [concat(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else None


# Matrices: (i, j) -> (cost, rope) for the ways that are possible.


def better(a: tuple, b: tuple | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and rope_less(a[1], b[1]))


def product(a: dict, b: dict) -> dict:
    """The cheapest ways over any state between; of equal costs the least audit.

    Two audits for the same rows at the same cost are never one the beginning
    of the other, so what follows them does not change their order.
    """
    out: dict = {}
    for (i, k), (cost, rope) in a.items():
        for j in STATES:
            step = b.get((k, j))
            if step is not None:
                way = cost + step[0], concat(rope, step[1])
                if better(way, out.get((i, j))):
                    out[i, j] = way
    return out


def _inserts() -> dict:
    """Any number of empty turns, the fewest that lead from state to state."""
    one = {(i, j): (INSERT, leaf("I")) for (i, initial), j in NEXT.items() if initial != "s"}
    out = {(i, i): (0, None) for i in STATES}
    for _ in STATES:
        longer = product(out, one)
        for key, way in longer.items():
            if better(way, out.get(key)):
                out[key] = way
    return out


CLOSURE = _inserts()


def symbol_matrix(symbol: int) -> dict:
    """Inserted turns, then what becomes of a row of this initial and fault."""
    initial, fault = (*INITIALS, "")[symbol % 4], FAULTS[symbol // 4]
    row = {(i, i): (DELETE, leaf("D")) for i in STATES}
    if fault not in ("blank", "duplicate"):
        left = TRUNCATED if fault == "truncated" else 0
        for (i, to), j in NEXT.items():
            ways = [(left, leaf("K"))] if to == initial else []
            if to != "s":
                ways.append((REROLE + left, leaf("R")))
            for way in ways:
                if better(way, row.get((i, j))):
                    row[i, j] = way
    return product(CLOSURE, row)


TERMINALS = [symbol_matrix(symbol) for symbol in range(SYMBOLS)]


def re_pair(sequences: Sequence[bytes]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (pairs of symbols, numbered on from the terminals) and shortened sequences."""
    lengths = [len(s) for s in sequences]
    symbols = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(sequences)), lengths)
    least = max(2, int(len(symbols) * LEAST_SHARE))
    rules: list[tuple[int, int]] = []
    while len(symbols) > 1:
        kinds = SYMBOLS + len(rules)
        inside = owner[:-1] == owner[1:]
        pairs = symbols[:-1] * kinds + symbols[1:]
        counts = np.bincount(pairs[inside], minlength=1)
        common = int(counts.argmax())
        at = np.flatnonzero(inside & (pairs == common))
        # Of overlapping pairs every other one.
        run = np.cumsum(np.concatenate([[0], np.diff(at) > 1])) if len(at) else at
        starts = np.searchsorted(run, run)
        at = at[(np.arange(len(at)) - starts) % 2 == 0] if common // kinds == common % kinds else at
        if len(at) < least:
            break
        rules.append(divmod(common, kinds))
        symbols[at] = kinds
        symbols, owner = np.delete(symbols, at + 1), np.delete(owner, at + 1)
    return rules, np.split(symbols, np.searchsorted(owner, np.arange(1, len(sequences))))


def rule_matrices(rules: Iterable[tuple[int, int]]) -> list[dict]:
    """A matrix for each symbol, those of rules from those before them."""
    matrices = list(TERMINALS)
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    return matrices


def finished(ways: dict) -> tuple[int, str]:
    """The cheapest way from the start to an end, and its audit."""
    best = None
    for (i, j), way in product(ways, CLOSURE).items():
        if i == START and j in (START, ASSISTANT) and better(way, best):
            best = way
    return best[0], letters(best[1])


def _illegal(symbols: bytes) -> int:
    """Neighbours whose initials may not follow one another."""
    rows = np.frombuffer(symbols, np.uint8) % 4
    pairs = rows[:-1] * 4 + rows[1:]
    return int((~np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])).sum())


def decoded(symbols: bytes, audit: str, state: int):
    """For each row its edit, new role (None if kept) and the turns inserted
    before it; then the turns inserted at the end."""
    rows, inserted = [], []
    place = 0
    for edit in audit:
        role = "assistant" if state == USER else "user"
        if edit == "I":
            inserted.append(role)
            state = NEXT[state, role[0]]
            continue
        if edit == "K":
            state = NEXT[state, INITIALS[symbols[place] % 4]]
        elif edit == "R":
            state = NEXT[state, role[0]]
        rows.append((edit, role if edit == "R" else None, inserted))
        inserted = []
        place += 1
    return rows, inserted


def damage(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with faults put in by crc32(id:turn) mod 20.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 sets
    its role to user. NULLs count as one space in the hash, role and text.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        spaced(role).alias("role"),
        spaced(text).alias("text"),
        F.pmod(F.crc32(key), F.lit(20)).alias("act"),
    ).where("act <> 0")
    act = F.col("act")
    return rows.select(
        "conv_id",
        "turn",
        F.when(act == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(act == 1, "")
        .when(act == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(act == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` without the text, with ``symbol`` and ``fault`` (NULL if there is none)."""
    first = rows.groupBy("conv", "role", "digest").agg(
        # NULL turns come first; of equal turns the row numbered first.
        F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("least")
    ).select("least.row", F.lit(True).alias("first"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.col("ended"), "truncated")
    )
    number = F.lit(0)
    for i, name in enumerate(FAULTS[1:], 1):
        number = F.when(F.col("fault") == name, i).otherwise(number)
    initial = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == letter, i).otherwise(initial)
    thin = rows.select(
        "conv", "turn", "role", "digest", "row",
        (bare == "").alias("blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"),
    )
    return (
        thin.join(first, "row", "left")
        .withColumn("fault", fault)
        .select(
            "conv", "turn", "role", "digest", "row", "fault",
            (number * 4 + initial).cast("int").alias("symbol"),
        )
    )


def _stretches(faults: DataFrame, kind: str) -> DataFrame:
    """Conversations, or the parts of them in a task, with what their edits cost.

    All but the first and last of a task are whole.
    """
    order = [
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "row"
    ]
    dealt = faults.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        convs = table["conv"].combine_chunks()
        rows = table["row"].to_numpy()
        symbols = table["symbol"].to_numpy().astype(np.uint8)
        codes = convs.dictionary_encode()
        codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        ends = np.append(starts[1:], len(codes))
        sequences = [symbols[a:b].tobytes() for a, b in zip(starts, ends)]
        distinct = {s: i for i, s in enumerate(dict.fromkeys(sequences))}
        rules, shortened = re_pair(list(distinct))
        matrices = rule_matrices(rules)
        solved: dict[bytes, tuple[int, str, int]] = {}
        out = []
        for n, (a, b, sequence) in enumerate(zip(starts, ends, sequences)):
            whole, short = 0 < n < len(starts) - 1, shortened[distinct[sequence]]
            if whole and sequence not in solved:
                ways = _times({(START, START): (0, None)}, short, matrices)
                solved[sequence] = (*finished(ways), _illegal(sequence))
            edges = None
            if not whole:
                ways = _times({(i, i): (0, None) for i in STATES}, short, matrices)
                edges = [
                    {"i": i, "j": j, "cost": cost, "audit": letters(rope)}
                    for (i, j), (cost, rope) in ways.items()
                ]
            found = solved[sequence] if whole else (None, None, _illegal(sequence))
            out.append((convs[int(a)].as_py(), part, rows[a:b], sequence, whole, *found, edges))
            if len(out) == OUT_ROWS:
                yield _batch(out, convs.type)
                out = []
        if out:
            yield _batch(out, convs.type)

    return dealt.select("conv", "row", "symbol").mapInArrow(
        run,
        f"conv {kind}, part int, rows array<long>, symbols binary, whole boolean, cost long, "
        "audit string, illegal long, ways array<struct<i:int,j:int,cost:long,audit:string>>",
    )


def _times(ways: dict, symbols: Iterable[int], matrices: list[dict]) -> dict:
    for symbol in symbols:
        ways = product(ways, matrices[symbol])
    return ways


def _batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    edge = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = [
        conv, pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.bool_(), pa.int64(), pa.string(),
        pa.int64(), pa.list_(edge),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
        ["conv", "part", "rows", "symbols", "whole", "cost", "audit", "illegal", "ways"],
    )


def _joined(stretches: DataFrame, kind: str) -> DataFrame:
    """Conversations over several tasks: ``conv``, ``part``, ``cost``, ``audit`` (of
    the part), ``illegal``, ``state`` (before the part).

    A conversation has one row per task it is in.
    """
    ends = stretches.select(
        "conv", "part", "ways", "illegal",
        F.expr("substring(symbols, 1, 1)").alias("first"), F.expr("substring(symbols, -1, 1)").alias("last"),
    )

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        illegal = sum(r["illegal"] for r in rows)
        illegal += sum(_illegal(a["last"] + b["first"]) for a, b in zip(rows, rows[1:]))
        # From each state the best way so far, with the states passed and the audits by part.
        ways = {START: (0, None, ())}
        for r in rows:
            after: dict = {}
            for edge in r["ways"]:
                before = ways.get(edge["i"])
                if before is None:
                    continue
                rope = rope_of(edge["audit"])
                way = before[0] + edge["cost"], concat(before[1], rope), (before[2], edge["i"], edge["audit"])
                if better(way, after.get(edge["j"])):
                    after[edge["j"]] = way
            ways = after
        best = None
        for (i, j), (cost, rope) in CLOSURE.items():
            if i in ways and j in (START, ASSISTANT):
                way = ways[i][0] + cost, concat(ways[i][1], rope), (ways[i][2], letters(rope))
                if better(way, best):
                    best = way
        chain, end = best[2]
        parts = []
        while chain:
            chain, state, audit = chain
            parts.append((state, audit))
        parts.reverse()
        parts[-1] = parts[-1][0], parts[-1][1] + end
        return pa.table(
            {
                "conv": table["conv"].combine_chunks().take(pa.array([0] * len(rows))),
                "part": pa.array([r["part"] for r in rows], pa.int32()),
                "cost": pa.array([best[0]] * len(rows), pa.int64()),
                "audit": pa.array([audit for _, audit in parts], pa.string()),
                "illegal": pa.array([illegal] * len(rows), pa.int64()),
                "state": pa.array([state for state, _ in parts], pa.int32()),
            }
        )

    return ends.groupBy("conv").applyInArrow(
        run, f"conv {kind}, part int, cost long, audit string, illegal long, state int"
    )


def _edits(pieces: DataFrame, kind: str) -> DataFrame:
    """One row per row of a conversation: its place, edit, new role and inserted turns."""

    def batch_of(out, conv):
        texts = pa.list_(pa.string())
        kinds = conv, pa.int64(), pa.int64(), pa.string(), pa.string(), texts, texts
        names = "conv", "row", "at", "edit", "role", "before", "after"
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(names)
        )

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                conv, part, numbers, symbols, audit, state = (c[k].as_py() for c in batch.columns)
                rows, end = decoded(symbols, audit, state)
                # A part's rows keep their order; parts follow one another.
                for at, (number, (edit, role, before)) in enumerate(zip(numbers, rows), part << 40):
                    out.append((conv, number, at, edit, role, before, []))
                    if len(out) >= OUT_ROWS and at + 1 < (part << 40) + len(rows):
                        yield batch_of(out, batch.column("conv").type)
                        out = []
                out[-1][-1].extend(end)
            if out:
                yield batch_of(out, batch.column("conv").type)

    return pieces.select("conv", "part", "rows", "symbols", "audit", "state").mapInArrow(
        run, _EDIT_SCHEMA.format(conv=kind)
    )


class Repair:
    """The repair of a table of conversations, as tables that are written once.

    ``rows`` are the repaired conversations, ``audits`` the costs and edits.
    """

    def __init__(
        self,
        conversations: DataFrame,
        conv_id: str = "conv_id",
        turn: str = "turn",
        role: str = "role",
        text: str = "text",
    ):
        kind = conversations.schema[conv_id].dataType.simpleString()
        spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        read = conversations.select(
            F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
            spaced(role).alias("role"), spaced(text).alias("text"),
        )
        # Numbers given by task are fixed by writing them.
        numbered = stored(
            read.select("*", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row")),
            "repair-rows",
        )
        self._faults = stored(_faults(numbered), "repair-faults")
        stretches = stored(_stretches(self._faults, kind), "repair-stretches")
        joined = stored(_joined(stretches.where("not whole"), kind), "repair-joined")
        whole = stretches.where("whole")
        part = stretches.where("not whole").select("conv", "part", "rows", "symbols")
        spread = part.join(
            joined.select(F.col("conv").alias("c"), F.col("part").alias("p"), "audit", "state"),
            F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")),
        )
        pieces = whole.withColumn("state", F.lit(START)).select("conv", "part", "rows", "symbols", "audit", "state").unionByName(
            spread.select("conv", "part", "rows", "symbols", "audit", "state")
        )
        ordered = F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), ""
        )
        self.audits = whole.select("conv", "cost", "illegal", "audit").unionByName(
            joined.groupBy("conv").agg(
                F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), ordered.alias("audit")
            )
        )
        edits = _edits(pieces, kind).withColumnRenamed("role", "new_role")
        empty = lambda roles: F.transform(
            roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
        )
        own = F.when(F.col("edit") == "D", F.array()).otherwise(
            F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text", "edit"))
        )
        stays = (F.col("edit") != "D") | (F.size("before") > 0) | (F.size("after") > 0)
        self.rows = (
            edits.where(stays)
            .join(numbered.select("row", "role", "text"), "row")
            .select("conv", "at", F.posexplode(F.concat(empty("before"), own, empty("after"))).alias("within", "line"))
            .select("conv", "at", "within", "line.role", "line.text", "line.edit")
        )
        self._kind = kind

    def counts(self) -> DataFrame:
        """``conv``, ``gaps`` in the turns, and rows ``blank``, ``duplicate``, ``truncated``."""
        fault = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        return self._faults.groupBy("conv").agg(
            F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
            *map(fault, FAULTS[1:]),
        ).select(
            "conv",
            F.coalesce(wide("high") - wide("low") + 1 - wide("turns"), F.lit(0)).cast("long").alias("gaps"),
            *FAULTS[1:],
        )

    def digests(self) -> DataFrame:
        """``conv`` and ``repaired_sha256``, of ``role:text`` lines joined by newlines.

        A hash reads its lines one after the other: a conversation's are sorted
        by Spark and streamed through one task, a line at a time.
        """
        order = ["conv", "at", "within"]

        def run(batches):
            now, digest, out = None, None, []
            for batch in batches:
                convs = batch.column("conv")
                for i, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())):
                    conv = convs[i].as_py()
                    if digest is None or conv != now:
                        if digest is not None:
                            out.append((now, digest.hexdigest()))
                        now, digest = conv, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(f"{role}:".encode("utf-8", "surrogatepass"))
                    digest.update(text.encode("utf-8", "surrogatepass"))
                if out:
                    yield _pairs(out, convs.type)
                    out = []
                kind = convs.type
            if digest is not None:
                yield _pairs([(now, digest.hexdigest())], kind)

        def _pairs(rows, kind):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())],
                ["conv", "repaired_sha256"],
            )

        lines = self.rows.select(*order, "role", "text").repartition("conv").sortWithinPartitions(*order)
        return lines.select("conv", "role", "text").mapInArrow(run, f"conv {self._kind}, repaired_sha256 string")


def repair_damaged(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation of the table: what its damaged rows lack and how they are mended.

    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256``. Rows are taken by turn, NULL turns first;
    rows of one turn by role, then by the text's SHA-256; rows equal in all that
    one after the other. NULL ids are one conversation, NULL roles and texts one
    space. A role of another initial, or an empty one, cannot be kept. A
    conversation all of whose rows are dropped has zeros, an empty audit and the
    hash of nothing. Repeated rows are duplicates. Texts of any length are read
    whole; an empty table gives no rows; further columns are not read.
    """
    repair = Repair(damage(conversations, conv_id, turn, role, text))
    out = conversations.select(F.col(conv_id).alias("conv_id")).distinct()
    for table in (repair.counts(), repair.audits, repair.digests()):
        same = F.col("conv_id").eqNullSafe(F.col("conv"))
        out = out.join(table, same, "left").drop("conv")
    numbers = ["gaps", *FAULTS[1:], "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id",
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ).fillna(0, numbers).fillna({"audit": "", "repaired_sha256": nothing})
