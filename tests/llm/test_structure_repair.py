import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from roundledger.llm import structure_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        act = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        role = "user" if act == 4 else role
        out += [(conv, turn, role, text)] * (2 if act == 3 else 1)
    return out


def faults_of(rows):
    """First fault of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        shown = VISIBLE.findall(text)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by trying, state by state, every way to every row."""

    def state(roles):
        return "" if not roles else "s" if roles == "s" else roles[-1]

    def add(table, roles, way):
        key = state(roles)
        if re.fullmatch("s?(ua)*u?", roles) and (key not in table or way[:2] < table[key][1][:2]):
            table[key] = roles, way
            return True
        return False

    def inserted(table):
        changed = True
        while changed:
            changed = False
            for roles, (cost, audit, lines) in list(table.values()):
                for role in ("user", "assistant"):
                    way = cost + 2, audit + "I", (*lines, f"{role}:")
                    changed |= add(table, roles + role[0], way)
        return table

    best = inserted({"": ("", (0, "", ()))})
    for (role, text), fault in zip(rows, faults):
        after = {}
        left = 1 if fault == "truncated" else 0
        for roles, (cost, audit, lines) in best.values():
            add(after, roles, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if role:
                add(after, roles + role[0], (cost + left, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                add(after, roles + other[0], (cost + 2 + left, audit + "R", (*lines, f"{other}:{text}")))
        best = inserted(after)
    return min((way for roles, way in best.values() if GOOD.match(roles)), key=lambda w: w[:2])


def plain(original):
    rows, out = damaged(original), []
    for conv in {r[0] for r in original}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        said = [(r[2], r[3]) for r in own]
        faults = faults_of(said)
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(said, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_rows(seed, conversations=120, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " ", "", "What?", "Tell me more", "ok!\n", "ünïcode. ", None, "\x0b\t"]
    rows = []
    for conv in range(conversations):
        conv = rng.choice([conv] * 20 + [None])
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "User"])
            text = rng.choice(texts) if rng.random() < 0.6 else f"line {rng.random()}."
            rows.append((conv, rng.choice([turn * 3] * 9 + [None]), role, text))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = some_rows(1)
    got = found(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    assert {len(r[7]) for r in got} >= {0, 5}


def test_one_conversation_of_half_the_rows_spreads_over_tasks(spark):
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{t}?"])) for t in range(700)]
    rows += some_rows(3, 80)
    table = spark.createDataFrame(rows, SCHEMA)
    # Small partitions are merged unless this is set.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(repair.repair_damaged(table)) == plain(rows)
        faults = repair.Repair(repair.damage(table))._faults
        stretches = repair._stretches(faults, "bigint")
        assert stretches.where("conv = 5").select("part").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_are_well_formed(spark):
    table = spark.createDataFrame(some_rows(4), SCHEMA)
    lines = repair.Repair(table).rows.collect()
    by_conv = itertools.groupby(sorted(lines, key=lambda r: (str(r.conv), r.at, r.within)), key=lambda r: r.conv)
    for _, own in by_conv:
        own = list(own)
        assert GOOD.match("".join(r.role[0] for r in own))
        assert all(r.text == "" for r in own if r.edit == "I")


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x", ""]), st.sampled_from(["a.", "b", "", "c?"])), max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=6))
def test_rules_and_matrices_equal_the_plain_search(conversations):
    sequences = []
    for rows in conversations:
        faults = faults_of(rows)
        initials = ["sua".find(role[0]) % 4 if role else 3 for role, _ in rows]
        sequences.append(bytes(4 * repair.FAULTS.index(f) + i for f, i in zip(faults, initials)))
    rules, short = repair.re_pair(sequences)
    matrices = repair.rule_matrices(rules)
    for rows, sequence, symbols in zip(conversations, sequences, short):
        opened = list(symbols)
        while any(x >= repair.SYMBOLS for x in opened):
            opened = [y for x in opened for y in (rules[x - repair.SYMBOLS] if x >= repair.SYMBOLS else [x])]
        assert bytes(opened) == sequence
        ways = repair._times({(0, 0): (0, None)}, symbols, matrices)
        assert repair.finished(ways) == cheapest(rows, faults_of(rows))[:2]


@settings(deadline=None)
@given(st.text("DIKR", max_size=12), st.text("DIKR", max_size=12), st.integers(0, 12))
def test_ropes_order_like_their_texts(a, b, cut):
    whole = repair.concat(repair.rope_of(a[:cut]), repair.rope_of(a[cut:]))
    assert repair.letters(whole) == a
    assert repair.rope_less(whole, repair.rope_of(b)) == (a < b)
    assert not repair.rope_less(whole, repair.rope_of(a))


def test_repeats_share_rules():
    rules, short = repair.re_pair([bytes([1, 2] * 64), bytes([0] + [1, 2] * 32)])
    assert sum(map(len, short)) < 8 and len(rules) < 12


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None), (1, None, "user", "x."), (1, None, "user", "x."), (1, 2**62, "a", "y" * 50_000),
        (1, -(2**61), "assistant", ""), (2, 0, "user", "hi."), (2, 0, "user", "hi."), (3, 7, "", "."),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(repair.repair_damaged(table)) == plain(rows)
    assert repair.repair_damaged(table.limit(0)).collect() == []
    more = table.selectExpr("*", "1 AS conv", "2 AS row", "3 AS act", "4 AS symbol", "5 AS cost")
    assert found(repair.repair_damaged(more)) == plain(rows)


def test_all_rows_dropped(spark):
    rows = [(i, 1, "user", "hello.") for i in range(200)]
    gone = [r for r in plain(rows) if r[7] == ""]
    assert gone and all(r[1:7] == (0,) * 6 for r in gone)
    assert found(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
