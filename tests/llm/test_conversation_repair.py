import hashlib
import re
from itertools import product
from zlib import crc32

import numpy as np
import pytest

from tuneforge.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile("(s?(ua)+)?")


def damaged(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired rows), by whole strings for each of the four states."""
    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, kept) in list(best.items()):
                to = 3 if state == 2 else 2
                way = (cost + 5, audit + "I", [*kept, ("assistant" if to == 3 else "user") + ":"])
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        step = {}
        for state, (cost, audit, kept) in inserted(best).items():
            ways = [(state, cost + 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = 3 if state == 2 else 2
                ways.append((to, cost + 1 + more, "R", [("assistant" if to == 3 else "user") + ":" + text]))
                keep = {"s": 1 if state == 0 else 0, "u": 2 if state != 2 else 0, "a": 3 if state == 2 else 0}.get(role[:1], 0)
                if keep:
                    ways.append((keep, cost + more, "K", [f"{role}:{text}"]))
            for to, price, letter, line in ways:
                way = (price, audit + letter, kept + line)
                if to not in step or way[:2] < step[to][:2]:
                    step[to] = way
        best = step
    return min((w for s, w in inserted(best).items() if s in (0, 3)), key=lambda w: w[:2])


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        found, turns = faults(own), [t for t, _, _ in own if t is not None]
        cost, audit, kept = cheapest(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made(seed, n, convs):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"], ["Hi.", "Hi.", "No end", " \t", "", None, "What?  \n", "Fine!", "a\nb.", "é…", "Ok. then"]
    turn = lambda: None if rng.integers(0, 12) == 0 else int(rng.integers(0, 9))
    return [(int(c) if c else None, turn(), roles[min(rng.integers(0, 14), 7) if rng.integers(0, 2) else rng.integers(0, 2)], texts[rng.integers(0, len(texts))]) for c in rng.integers(0, convs, n)]


def result(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies", "2 AS part", "3 AS n", "'x' AS audit")
    found = repair.digest(repair.repair(repair.damage(table.repartition(3)), **options)).collect()
    out = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


def test_equals_plain_version(spark):
    rows = made(1, 500, 90)
    rows += [(1000, t, ["user", "assistant"][t % 2], "All well.") for t in range(12)] + [(1001, 3, "user", "long " * 200_000)] * 2
    rows += [(c, 0, "user", "gone") for c in range(2000, 2040)]  # some of them lose their only row
    want = expected(rows)
    assert any(w[6] == "" and w[5] == 0 for w in want.values())
    assert result(spark, rows) == want


@pytest.mark.parametrize("block", [4, 11])
def test_long_conversations_in_blocks_of_blocks(spark, block):
    rows = made(2, 60, 4) + [(7, t, ["user", "assistant", "system", None][(t * t + t // 7) % 4], ["Yes.", "cut", "", f"t{t // 3}!"][t * 7 % 4]) for t in range(130)]
    assert result(spark, rows, block=block) == expected(rows)


def test_repaired_rows_alternate(spark):
    rows = made(3, 200, 20)
    blocks = repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA)), block=4)
    found = {}
    for r in sorted(repair.repaired_rows(blocks).collect(), key=lambda r: (r.part, r.chunk, r.place)):
        found.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(FORM.fullmatch("".join(f)) for f in found.values())


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_plain_version_against_all_edits():
    """The dynamic program of these tests is the least over all edit sequences of short conversations."""
    gaps = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant"}
    kinds = [("user", "Hi."), ("assistant", "Yes."), ("system", "Be."), ("user", "cut"), ("tool", "x."), ("user", "")]
    for rows in product(kinds, repeat=2):
        table = [(i, *r) for i, r in enumerate(rows)]
        marks = faults(table)
        options = []
        for (_, role, text), fault in zip(table, marks, strict=True):
            more = 5 * (fault == "truncated")
            ways = [(2, "D", "", [])]
            if fault not in ("blank", "duplicate"):
                ways += [(more, "K", role[0], [f"{role}:{text}"])] + [(1 + more, "R", c, [f"{n}:{text}"]) for c, n in names.items()]
            options.append(ways)
        best = None
        for ins in product(gaps, repeat=3):
            for edits in product(*options):
                form = ins[0] + "".join(e[2] + g for e, g in zip(edits, ins[1:], strict=True))
                if FORM.fullmatch(form):
                    cost = sum(e[0] for e in edits) + 5 * sum(map(len, ins))
                    audit = "I" * len(ins[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(edits, ins[1:], strict=True))
                    kept = [names[c] + ":" for c in ins[0]] + [line for e, g in zip(edits, ins[1:], strict=True) for line in [*e[3], *[names[c] + ":" for c in g]]]
                    if best is None or (cost, audit) < best[:2]:
                        best = (cost, audit, kept)
        assert cheapest(table) == best
