"""Repairs against the plain minimum over all edit strings, and the query against all of it in plain Python."""

import hashlib
import random
import re
import zlib
from functools import cache

from ledgerloom.llm import conversations as cv

SF = "/root/testdata/sf0.001"
INK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(codes):
    """(cost, audit) of the least pair, by trying every edit at every place; up to two insertions in a row can help."""

    @cache
    def best(i, roles, inserted):
        # roles: the last two initials written, which is all that the rule looks back at.
        tries = []
        if i == len(codes) and roles[-1:] in ("", "a"):
            tries.append((0, ""))
        wanted = "a" if roles[-1:] == "u" else "u"
        if inserted < 2:
            c, s = best(i, (roles + wanted)[-2:], inserted + 1)
            tries.append((c + 2, "I" + s))
        if i < len(codes):
            initial, must_go, cut = codes[i]
            c, s = best(i + 1, roles, 0)
            tries.append((c + 3, "D" + s))
            if not must_go:
                c, s = best(i + 1, (roles + wanted)[-2:], 0)
                tries.append((c + 2 + cut, "R" + s))
                if initial == wanted or (initial == "s" and not roles):
                    c, s = best(i + 1, (roles + initial)[-2:], 0)
                    tries.append((c + cut, "K" + s))
        return min(tries, default=(10**9, ""))

    for i in range(len(codes), 0, -1):  # from the end, so that no call goes deep
        for roles in ("", "s", "u", "su", "ua", "au"):
            best(i, roles, 0)
    return best(0, "", 0)


def test_walks_are_the_least_of_the_cheapest():
    rng = random.Random(3)
    for _ in range(600):
        codes = [(rng.choice("suuaaax"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        dist = cv.distances(codes, cv.AT_END)
        state, letters = cv.walk(codes, dist, 0)
        letters += "I" * (cv.AT_END[state] // 2)
        assert (dist[0], letters) == cheapest(tuple(codes))


def brute(rows):
    """Everything about one conversation's rows (turn, role, text), with nulls as they are."""
    conv = {}
    for c, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        conv.setdefault(c, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for c, found in conv.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen, codes = [], set(), []
        for _, role, text in found:
            ink = INK.findall(text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            codes.append((role[:1], fault in ("blank", "duplicate"), bool(ink) and ink[-1] not in ".!?"))
        cost, audit = cheapest(tuple(codes))
        said, i, roles = [], 0, ""
        for x in audit:
            wanted = "assistant" if roles[-1:] == "u" else "user"
            if x == "I":
                said.append(wanted + ":")
                roles += wanted[0]
                continue
            if x in "KR":
                role = found[i][1] if x == "K" else wanted
                said.append(f"{role}:{found[i][2]}")
                roles += role[0]
            i += 1
        assert re.fullmatch("(s?(ua)+)?", roles)
        turns = {t for t, _, _ in found if t is not None}
        initials = [r[:1] for _, r, _ in found]
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def shown(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert shown(cv.repair_digest(table)) == brute([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table.collect()])


def edge_rows():
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (7, None, "assistant", "x"), (7, None, "system", "Be good."), (7, 2, "", "What?"), (7, 2, "", "What?"), (7, -900, "usher", "Here.")]
    # One conversation of many blocks, with gaps, repeats across blocks and rows that end anyhow.
    rows += [(8, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"Answer {t}!", " \t", f"Word {t}"])) for t in range(900) if rng.random() < 0.8]
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")], dropped


def test_edges_and_blocks(spark):
    rows, dropped = edge_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, block int")
    want = brute(rows)
    assert want[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert shown(cv.repair_digest(df)) == want
    for turns in (16, 100_000):
        got = {int(r.conv.id) if r.conv.known else None: (r.cost, r.audit, r.duplicate, r.repaired_sha256) for r in cv.repaired(cv.damaged(df), turns).collect()}
        assert got == {c: (v[5], v[6], v[2], v[7]) for c, v in want.items()}
    assert cv.repair_digest(df.limit(0)).collect() == []
