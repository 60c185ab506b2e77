"""Repairs of conversations against a search of all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

pytest.importorskip("public_tokenizers")

from fieldloom.llm import conversation_repair as repair  # noqa: E402
from fieldloom.llm import queries  # noqa: E402

BLANKS = " \t\n\v\f\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults_of(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANKS)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(roles, faults):
    """(cost, audit, made) by trying all edits; states are what was made so far, as far as it matters."""

    @cache
    def best(at, last, inserts):
        found = []
        if at == len(roles):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            need = "a" if last == "u" else "u"
            c, e, m = best(at + 1, last, 0)
            found.append((c + 3, "D" + e, m))
            if faults[at] in ("", "truncated"):
                more = 1 if faults[at] else 0
                for made, cost, letter in [(need, 2, "R"), *([(roles[at][:1], 0, "K")] if roles[at][:1] == need or (roles[at][:1] == "s" and not last) else [])]:
                    c, e, m = best(at + 1, made, 0)
                    found.append((c + cost + more, letter + e, ((made, at, letter), *m)))
        if inserts < 3:
            made = "a" if last == "u" else "u"
            c, e, m = best(at, made, inserts + 1)
            found.append((c + 2, "I" + e, ((made, None, "I"), *m)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


def expected(conv, rows):
    mine = [r for r in rows if r[0] == conv]
    mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, turns = faults_of(mine), [r[1] for r in mine if r[1] is not None]
    cost, audit, made = cheapest(tuple(r[2] for r in mine), tuple(faults))
    full = {"u": "user", "a": "assistant"}
    lines = [f"{mine[at][2] if letter == 'K' else full[m]}:{mine[at][3] if at is not None else ''}" for m, at, letter in made]
    initials = [r[2][:1] for r in mine]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_cheapest_edits():
    rng = random.Random(5)
    graph = repair.SuffixGraph()
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "ux"]), rng.choice(["", "", "truncated", "duplicate", "blank"])) for _ in range(rng.randint(0, 9))]
        signature = "".join(repair.LETTERS[r[:1] if r[:1] in ("s", "u", "a") else "o", f] for r, f in rows)
        cost, audit, _ = cheapest(tuple(r for r, _ in rows), tuple(f for _, f in rows))
        assert repair.report(graph, signature)[-2:] == (cost, audit), rows


def test_nodes_are_shared():
    rng = random.Random(1)
    signatures = sorted({"".join(rng.choice("aei") for _ in range(rng.randint(0, 6))) for _ in range(2000)}, key=lambda s: s[::-1])
    graph = repair.SuffixGraph()
    for s in signatures:
        graph.add(s)
    assert graph.made == len({s[n:] for s in signatures for n in range(len(s))})


def odd_rows():
    rng = random.Random(11)
    rows = [(None, None, None, None), (None, 3, "user", "Hm."), (900, None, "user", "A."), (900, None, "user", "A."), (900, 2, "assistant", None), (901, 4, None, ""), (902, -5, "user", "x" * 200_000)]
    rows += [(903, t, "user" if t % 2 else "assistant", "Long.") for t in range(250)] + [(904, -(2**62), "user", "Far."), (904, 2**62, "user", "Off.")]
    for conv in range(150):
        turn = 0
        for _ in range(rng.randint(0, 9)):
            turn += rng.choice([0, 1, 1, 1, 3])
            said = rng.choice(["Yes.", "No", " ", "", "Why?\n", "Ends. not", "Ünd!", "a\x0b.", "Yes. "])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), said))
    return rows


def test_query(spark, tmp_path):
    rows = odd_rows()
    schema = "conv_id long, turn long, role string, text string, conv string, sha string, signature string"
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op11_conversation_repair(spark, str(tmp_path))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    damaged = after_damage(rows)
    want = [expected(c, damaged) for c in {r[0] for r in rows}]
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r[n] for n in names) for r in found.collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g == w
    assert queries.op11_conversation_repair(spark, _empty(spark, frame, tmp_path)).count() == 0


def _empty(spark, frame, tmp_path):
    frame.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    return str(tmp_path / "none")


def test_repaired_rows(spark):
    rows = [("a", 1, "assistant", "Hi."), ("a", 2, "user", "Why?"), ("b", 1, "system", "Be kind."), ("b", 2, "user", "So"), ("b", 2, "user", "So")]
    frame = spark.createDataFrame(rows, "c string, t int, r string, x string")
    names = dict(conv="c", turn="t", role="r", text="x")
    reports = repair.repair_reports(frame, spark.createDataFrame([("none",)], "c string"), **names)
    audits = {r.c: (r.cost, r.audit) for r in reports.collect()}
    assert audits == {"a": (4, "IKKI"), "b": (6, "KKDI"), "none": (0, "")}
    made = repair.repaired_rows(frame, reports, **names).orderBy("c", "place").collect()
    assert [(r.c, r.place, r.role, r.text) for r in made] == [
        ("a", 0, "user", ""), ("a", 1, "assistant", "Hi."), ("a", 2, "user", "Why?"), ("a", 3, "assistant", ""),
        ("b", 0, "system", "Be kind."), ("b", 1, "user", "So"), ("b", 2, "assistant", ""),
    ]
