import hashlib
import random
import re
from zlib import crc32

import pytest

from netloom.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = crc32(key.encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def brute(rows, convs):
    """Every row by itself; the best suffix of edits is kept as (cost, letters)."""
    out = []
    for conv in convs:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        best = {}
        for i in range(len(own), -1, -1):
            options = {s: [(0, "")] if i == len(own) and s in ("", "a") else [] for s in step}
            if i < len(own):
                extra, must = int(faults[i] == "truncated"), faults[i] in ("blank", "duplicate")
                for s in step:
                    c, t = best[i + 1, s]
                    options[s].append((c + 3, "D" + t))
                    if not must:
                        to = step[s].get(own[i][2][:1])
                        if to:
                            c, t = best[i + 1, to]
                            options[s].append((c + extra, "K" + t))
                        to = "a" if s == "u" else "u"
                        c, t = best[i + 1, to]
                        options[s].append((c + 2 + extra, "R" + t))
            value = {s: min(o, default=(10**9, "")) for s, o in options.items()}
            for _ in range(4):
                for s in step:
                    c, t = value["a" if s == "u" else "u"]
                    value[s] = min(value[s], (c + 2, "I" + t))
            for s in step:
                best[i, s] = value[s]
        cost, audit = best[0, ""]
        state, lines, i = "", [], 0
        for letter in audit:
            new = "a" if state == "u" else "u"
            if letter == "D":
                i += 1
                continue
            if letter == "K":
                lines.append(f"{own[i][2]}:{own[i][3]}")
                state = own[i][2][:1]
                i += 1
                continue
            lines.append({"u": "user:", "a": "assistant:"}[new] + (own[i][3] if letter == "R" else ""))
            state = new
            i += letter == "R"
        initials = "".join(x[0] for x in lines)
        assert re.fullmatch("(s?(ua)+)?", initials)
        out.append((
            conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def sample(seed, convs=60, longest=30):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        n = r.choice([1, 2, 3, 8, longest])
        turn = 0
        for k in range(n):
            turn += r.choice([1, 1, 1, 1, 2, 0])
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[k % 2]
            if r.random() < 0.08:
                role = r.choice(["system", "", "tool", None, "Über", "unknown"])
            text = r.choice(["Yes.", "No!", "why", "ok", "", " \t\n", None, "é?", "A? b", "x. \n", "…", "T%d." % k, "word %d" % k])
            rows.append((conv, turn if r.random() > 0.05 else None, role, text))
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", "Hi.")]
    rows += [r.choice(rows) for _ in range(40)]
    r.shuffle(rows)
    return rows


def got(spark, rows, parts, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS copies", "'x' AS piece", "2 AS seq", "3 AS open", "4 AS again")
    found = R.repair(R.damaged(df), parts)
    assert found.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 50), (4, 120)])
def test_equals_brute_force_for_any_number_of_ranges(spark, seed, parts):
    rows = sample(seed)
    assert got(spark, rows, parts) == brute(damage(rows), {r[0] for r in rows})


def test_one_conversation_over_all_ranges(spark):
    rows = [r for r in sample(9, 3, 400) if r[0] is not None]
    rows += [(1, 500 + k, ("user", "assistant")[k % 3 % 2], "Line %d%s" % (k, "." if k % 5 else "")) for k in range(700)]
    rows += [(1, 77, "user", "Again and again.")] * 300
    assert got(spark, rows, 40) == brute(damage(rows), {r[0] for r in rows})


def test_dropped_conversation_and_empty_table(spark):
    gone = next(k for k in range(1000) if crc32(f"{k}:5".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(gone, 5, "user", "Hi.")], 3) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert got(spark, [], 3) == []


def test_without_damage(spark):
    rows = [(1, 1, "user", "A."), (1, 2, "assistant", "B."), (2, 1, "assistant", "B.")]
    found = R.repair(R.undamaged(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((r.conv_id, r.cost, r.audit) for r in found.collect()) == [(1, 0, "KK"), (2, 2, "IK")]


def test_checkpoints_do_not_change_the_walk():
    r = random.Random(2)
    rows = [(k, r.choice([b"user", b"assistant", b"system"]), b"t%d" % k + r.choice([b".", b""]), 1) for k in range(500)]
    at = R.repaired(rows)
    rough = R.isqrt
    try:
        R.isqrt = lambda n: n or 1
        assert R.repaired(rows) == at
        R.isqrt = lambda n: 1
        assert R.repaired(rows) == at
    finally:
        R.isqrt = rough
