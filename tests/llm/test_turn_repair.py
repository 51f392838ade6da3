import hashlib
import itertools
import random
import re
import zlib

from tessera.llm.common import small_batches
from tessera.llm.turn_repair import SHARED, answers, damage, op12_turn_repair, repair, repaired_digests

SCHEMA = "conv_id long, turn long, role string, text string, h string, facts string, part string, absent string"
SPACES = " \t\n\x0b\x0c\r"


def roles_of(signature, audit):
    """Role initials that an audit leaves, each rerole and insertion given what must stand there; none if it doesn't fit."""
    at, roles = 0, ""
    for edit in audit:
        symbol = None
        if edit != "I":
            if at == len(signature):
                return None
            symbol = signature[at]
            at += 1
        if edit == "D":
            continue
        if symbol == "X":
            return None
        roles += symbol.lower() if edit == "K" else "a" if roles[-1:] == "u" else "u"
    return roles if at == len(signature) and re.fullmatch("(s?(ua)+)?", roles) else None


def price(signature, audit):
    at, cost = 0, 0
    for edit in audit:
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[edit]
        if edit != "I":
            cost += 5 * (edit != "D" and signature[at] in "SUAO")
            at += 1
    return cost


def test_answers_are_the_least_of_all_edits():
    for n in range(4):
        signatures = sorted("".join(x) for x in itertools.product("XsuaoSUAO", repeat=n))
        signatures = random.Random(1).sample(signatures, min(40, len(signatures)))
        for signature, cost, audit in answers(sorted(signatures)):
            every = ("".join(x) for m in range(n, n + 4) for x in itertools.product("DIKR", repeat=m) if len(x) - x.count("I") == n)
            assert (cost, audit) == min((price(signature, x), x) for x in every if roles_of(signature, x) is not None), signature


def suffixes(signature):
    """Cheapest, ASCII-least audit from the end backwards: (cost, audit) for each state at each place."""
    follow = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    must = {"e": "u", "s": "u", "u": "a", "a": "u"}

    def closed(here):
        for _ in range(3):
            for q in "esua":
                c, t = here[must[q]]
                here[q] = min(here[q], (c + 5, "I" + t))
        return here

    here = closed({"e": (0, ""), "a": (0, ""), "s": (10**9, "~"), "u": (10**9, "~")})
    for symbol in reversed(signature):
        there, late = here, 5 * symbol.isupper()
        here = {}
        for q in "esua":
            moves = [(there[q][0] + 2, "D" + there[q][1])]
            if symbol != "X":
                if symbol.lower() in follow[q]:
                    c, t = there[follow[q][symbol.lower()]]
                    moves.append((c + late, "K" + t))
                c, t = there[must[q]]
                moves.append((c + late + 1, "R" + t))
            here[q] = min(moves)
        here = closed(here)
    return here["e"]


def test_shared_prefixes_and_long_signatures():
    r = random.Random(2)
    stems = ["".join(r.choices("XsuaoSUAO", k=60)) for _ in range(5)]
    signatures = sorted({s[: r.randint(0, 60)] + "".join(r.choices("XsuaoSUAO", k=r.randint(0, 30))) for s in stems for _ in range(60)} | {"", "ua" * SHARED + "u", "ua" * SHARED + "oX"})
    got = list(answers(signatures))
    assert [x for x, *_ in got] == signatures
    for signature, cost, audit in got:
        assert (cost, audit) == suffixes(signature)


def plain(rows):
    """The report of each conversation, by dictionaries and loops."""
    by, all_ids = {}, {r[0] for r in rows}
    for conv, turn, role, text, absent in rows:
        if not absent:
            by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in all_ids:
        own = sorted(by.get(conv, []), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        turns, seen, signature, counts = [t for t, *_ in own if t is not None], set(), "", dict.fromkeys("bdt", 0)
        for _, role, text in own:
            short = text.strip(SPACES)
            fault = "b" if not short else "d" if (role, text) in seen else "t" if short[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "X" if fault in ("b", "d") and fault else symbol.upper() if fault else symbol
        cost, audit = suffixes(signature)
        rest, roles, said = list(own), "", []
        for edit in audit:
            _, role, text = rest.pop(0) if edit != "I" else (0, "", "")
            if edit != "D":
                role = role if edit == "K" else "assistant" if roles[-1:] == "u" else "user"
                roles += role[:1]
                said.append(f"{role}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_odd_turns(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, None, 5]), r.choice([None, 0, 1, 2, 3, 9]), r.choice(["user", "assistant", "system", None, "", "tool", "u", "é"]), r.choice(["Yes.", "No", " \t", "", None, "ok!\n", "é? ", "Yes."]), r.random() < 0.1) for _ in range(120)]
    rows += [(7, 1, "user", "gone.", True), (8, -(2**62), "user", "far.", False), (8, 2**62, "assistant", "away. " * 20_000, False)]
    rows += [(9, k, ("user", "assistant")[k % 2], f"long {k}.", False) for k in range(3000)] + [(10, 0, "user", "same.", False)] * 50
    df = spark.createDataFrame([(*x[:4], "x", "x", "x", x[4]) for x in rows], SCHEMA.replace("absent string", "absent boolean"))
    with small_batches(spark, rows=7):
        got = {x.conv: x for x in repaired_digests(df, absent="absent").collect()}
        report, repaired = repair(df, absent="absent")
        report, repaired = {x.conv: x for x in report.collect()}, repaired.collect()
    want = plain(rows)
    assert set(got) == set(report) == set(want)
    said = {}
    for x in sorted(repaired, key=lambda x: x.at):
        said.setdefault(x.conv, []).append(x)
    for conv, facts in want.items():
        assert tuple(got[conv][f] for f in FIELDS) == facts, conv
        assert tuple(report[conv][f] for f in FIELDS[:-1]) == facts[:-1]
        own = said.get(conv, [])
        assert [x.at for x in own] == list(range(len(own))) and "".join(x.edit for x in own) == facts[-2].replace("D", "")
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == facts[-1]


def test_no_turns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repaired_digests(df).count() == 0 and [x.count() for x in repair(df)] == [0, 0]


def test_damage_and_query(spark, tmp_path):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["What? No.", "a", None, "b!"])) for c in [*range(60), None] for t in [*range(r.randint(1, 6)), None]]
    spark.createDataFrame([(*x, *["x"] * 4) for x in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    made = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        made += [(conv, turn, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    df = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, damage(df).collect()), key=key) == sorted(made, key=key)
    got = {x.conv_id: tuple(x)[1:] for x in op12_turn_repair(spark, str(tmp_path)).collect()}
    assert got == plain(made)
