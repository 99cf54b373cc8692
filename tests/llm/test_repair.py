import hashlib
import itertools
import random
import re
import zlib

import pytest

from graphjobs.llm import queries, repair

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """The contract's damage, row by row, on tuples (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        letters = BLANK.findall(text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def searched(turns, found):
    """The cheapest (cost, audit, lines) of all sequences of edits with up to two insertions
    before each turn, by trying them one after the other."""
    best = None
    legal = re.compile("(s?(ua)+)?")
    inserts = [(), *(p for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n))]
    choices = []
    for (_, _, role, text), f in zip(turns, found, strict=True):
        own = [("D", repair.DELETE, None)]
        if f not in ("blank", "duplicate"):
            more = repair.TRUNCATED * (f == "truncated")
            own += [("K", more, (role, text)), *(("R", more + repair.REROLE, (r, text)) for r in ("user", "assistant"))]
        choices.append([(c, i) for c in own for i in inserts])
    for picked in itertools.product(*choices, inserts):
        cost, audit, lines = 0, "", []
        for edit, put in picked[:-1]:
            cost += edit[1] + repair.INSERT * len(put)
            audit += "I" * len(put) + edit[0]
            lines += [(r, "") for r in put] + ([edit[2]] if edit[2] else [])
        cost, audit = cost + repair.INSERT * len(picked[-1]), audit + "I" * len(picked[-1])
        lines += [(r, "") for r in picked[-1]]
        if legal.fullmatch("".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def folded(turns, found):
    """The same by a table over all states, each plan kept as a tuple: for longer ones."""
    states = {"": (0, "", ())}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def with_inserts(table):
        out = dict(table)
        for _ in range(4):
            for s, (c, p, lines) in list(out.items()):
                for r in follows[s].replace("s", ""):
                    better(out, r, (c + repair.INSERT, p + "I", (*lines, (names[r], ""))))
        return out

    for (_, _, role, text), f in zip(turns, found, strict=True):
        after = {}
        for s, (c, p, lines) in with_inserts(states).items():
            better(after, s, (c + repair.DELETE, p + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            more = repair.TRUNCATED * (f == "truncated")
            if role[:1] and role[:1] in follows[s]:
                better(after, role[:1], (c + more, p + "K", (*lines, (role, text))))
            for r in follows[s].replace("s", ""):
                better(after, r, (c + more + repair.REROLE, p + "R", (*lines, (names[r], text))))
        states = after
    cost, audit, lines = min(v for s, v in with_inserts(states).items() if s in ("", "a"))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def expected(turns, solve):
    turns = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
    found = faults(turns)
    numbers = {t[1] for t in turns if t[1] is not None}
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, text = solve(turns, found)
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, text)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, audit string")


def test_short_conversations_against_all_edits(spark):
    rng = random.Random(11)
    rows, texts = [], ["Yes.", "No", "", " \t", "Why?", "Oh! ", "é…", "so. on"]
    for conv in range(120):
        turns = rng.choices([None, 0, 1, 2, 5, 9], k=rng.randint(1, 3))
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "tool", "", "s", "umpire"]), rng.choice(texts)) for t in turns]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame(spark, rows)).collect()}
    for conv in range(120):
        turns = [r for r in rows if r[0] == conv]
        assert got[conv] == expected(turns, searched) == expected(turns, folded), turns


@pytest.mark.parametrize("block", [1, 3, repair.BLOCK])
def test_blocks_don_t_matter(spark, block):
    rng = random.Random(12)
    rows = [(conv, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c.", "d!", ""]) + (str(t) if rng.random() < 0.5 else "")) for conv in range(40) for t in range(rng.randint(0, 25))]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame(spark, rows), block).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == expected([r for r in rows if r[0] == conv], folded)


def test_a_long_conversation(spark):
    rng = random.Random(13)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{t}" + rng.choice([".", ""])) for t in range(20_000)]
    (got,) = repair.repair(frame(spark, rows)).collect()
    assert got.truncated == sum(not r[3].endswith(".") for r in rows) and got.illegal == sum(a[2] == b[2] for a, b in itertools.pairwise(rows))
    assert len(got.audit.replace("I", "")) == 20_000
    states = ["user" if k % 2 == 0 else "assistant" for k in range(got.repaired.count("\n") + 1)]
    assert [x.split(":")[0] for x in got.repaired.split("\n")] == states and states[-1] == "assistant"


def test_nulls_and_lost_conversations(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), *((k, 0, "user", "A.") for k in range(60)), *((k, 1, "assistant", "B.") for k in range(60))]
    df = frame(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(repair.repair(repair.damaged(df)), df).collect()}
    assert set(got) == {None, *range(60)}
    for conv in got:
        turns = damage([r for r in rows if r[0] == conv])
        want = expected(turns, folded)
        assert got[conv] == (*want[:-1], hashlib.sha256(want[-1].encode()).hexdigest())
    assert repair.repair(frame(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_repair"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want = expected(damage([r for r in rows if r[0] == conv]), folded)
        assert got[conv] == (*want[:-1], hashlib.sha256(want[-1].encode()).hexdigest())
