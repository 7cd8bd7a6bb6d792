import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sourcerank.llm import conversation_repair as cr
from tests.llm.conftest import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in CLASHES + ["kind", "place", "edit", "flag"])
WIDTH = len(CLASHES) + 4


def brute(symbols):
    """The least (cost, audit) over all edits of short conversations, at most two insertions in a row."""
    best = None
    for edits in itertools.product("DKR", repeat=len(symbols)):
        for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
            roles, cost, audit = "", 0, ""
            for k in range(len(symbols) + 1):
                audit += "I" * inserts[k]
                roles += "?" * inserts[k]
                cost += 2 * inserts[k]
                if k == len(symbols):
                    continue
                s, e = symbols[k], edits[k]
                audit += e
                if e == "D":
                    cost += 3
                    continue
                if s == "d":
                    cost = 10**6
                roles += s.lower() if e == "K" else "?"
                cost += (2 if e == "R" else 0) + s.isupper()
            if best is not None and (cost, audit) >= best:
                continue
            # A new turn is a user's or an assistant's, as the pattern asks.
            if any(fits(roles, want) for want in shapes(len(roles))):
                best = (cost, audit)
    return best


def shapes(n):
    return [w for w in ("ua" * (n // 2), "s" + "ua" * ((n - 1) // 2)) if len(w) == n and w != "s"]


def fits(roles, want):
    return all(a == b or (a == "?" and b != "s") for a, b in zip(roles, want))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_equals_all_edits(n):
    for symbols in itertools.product("suaxUAd", repeat=n):
        assert cr.cheapest("".join(symbols)) == brute("".join(symbols))


def test_search_equals_all_edits_longer():
    rng = random.Random(4)
    for _ in range(25):
        symbols = "".join(rng.choice("suaxSUAXd") for _ in range(4))
        assert cr.cheapest(symbols) == brute(symbols)


@pytest.mark.parametrize("segment", [1, 2, 5, 64])
def test_segments_give_the_same_plan(segment):
    rng = random.Random(segment)
    for _ in range(60):
        symbols = "".join(rng.choice("suauauaxUAd") for _ in range(rng.randint(0, 40)))
        search = cr.Search(segment)
        for s in symbols:
            search.add(s)
        assert search.result() == cr.cheapest(symbols)


def test_bounds_never_exceed_the_cost():
    rng = random.Random(1)
    for _ in range(100):
        symbols = "".join(rng.choice("suaxUAd") for _ in range(rng.randint(0, 12)))
        bounds = cr.suffix_bounds(symbols, (0, 3))
        for place in range(len(symbols) + 1):
            for state in range(4):
                assert bounds[4 * place + state] <= cr.cheapest(symbols[place:], state)[0] <= bounds[4 * place + state] + 4


def test_search_is_linear_in_the_turns():
    rng = random.Random(2)
    symbols = "".join(rng.choice("suaxUAd") for _ in range(20_000))
    cost, audit = cr.cheapest(symbols)
    assert len(audit.replace("I", "")) == 20_000 and cost > 0


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def expected(conv, rows):
    """The contract told row by row."""
    turns = [r for r in harmed(rows) if r[0] == conv]
    key = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, key(r)))
    seen, symbols, counts = set(), "", dict(blank=0, duplicate=0, truncated=0)
    for _, _, role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        letter = role[:1] if role[:1] and role[:1] in "sua" else "x"
        symbols += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    numbers = [r[1] for r in turns if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit = brute(symbols) if len(symbols) <= 4 else cr.cheapest(symbols)
    lines, k = [], 0
    for e in audit:
        row = None if e == "I" else turns[k]
        k += e != "I"
        if e == "D":
            continue
        after = [x for x in lines if not x.startswith("s")]
        role = row[2] if e == "K" else ("assistant" if len(after) % 2 else "user")
        lines.append(f"{role}:{row[3] if row else ''}")
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", "Really? ", "", " \n", None, f"text {rng.randrange(9)}.", "Été 日本。", "a\x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [r for r in rows if r[0] == 5] + [(99, 0, "user", "x" * 300_000 + "."), (99, 1, "assistant", "y. " * 100_000)]
    return rows


def test_digest_follows_the_contract(spark, talks):
    df = spark.createDataFrame([(*r, *["x"] * WIDTH) for r in talks], SCHEMA).repartition(3)
    rows, there = cr.damaged(df)
    got = {r["conv_id"]: tuple(r) for r in cr.digest(rows, there).collect()}
    assert got == {c: expected(c, talks) for c in {r[0] for r in talks}}


def test_long_conversation_in_segments(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"{k}.", f"{k}", "Yes."])) for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    short, whole = (cr.plans(df, segment=n).collect() for n in (64, 5000))
    assert short == whole
    turns = cr.repaired(df).orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))
    assert [r["place"] for r in turns] == list(range(len(turns)))
    every = cr.repaired(df, deleted=True)
    assert every.filter("edit <> 'I'").count() == 900


def test_dropped_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.digest(none).count() == 0 and cr.repaired(none).count() == 0
    gone = spark.createDataFrame([(3, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    row = cr.digest(gone, F.lit(False)).collect()[0]
    assert tuple(row) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
