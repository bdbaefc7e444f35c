"""Conversation repair against a plain recursion over all edits, whole conversations and blocks of any size."""

import hashlib
import random
from functools import lru_cache

import pytest

from codexmill.llm import queries, repair

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """rows: (turn, role, text) after damage, in order. The contract, word by word."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, place, inserts):
        """(cost, audit, lines) from row i on; two inserts in a row are tried too."""
        found = [(0, "", ())] if i == len(rows) and place in ("", "a") else []

        def add(cost, mark, rest, line=None):
            if rest is not None:
                found.append((cost + rest[0], mark + rest[1], ((line,) if line is not None else ()) + rest[2]))

        if inserts < 2:
            for role in ("user", "assistant"):
                if (place, role[0]) in NEXT:
                    add(5, "I", best(i, NEXT[place, role[0]], inserts + 1), f"{role}:")
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", best(i + 1, place, 0))
            if faults[i] not in ("blank", "duplicate"):
                charge = 5 * (faults[i] == "truncated")
                if (place, role[:1]) in NEXT:
                    add(charge, "K", best(i + 1, NEXT[place, role[:1]], 0), f"{role}:{text}")
                for other in ("user", "assistant"):
                    if (place, other[0]) in NEXT:
                        add(1 + charge, "R", best(i + 1, NEXT[place, other[0]], 0), f"{other}:{text}")
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 2, 3, 512])
def test_against_plain_recursion(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for conv in range(60):
        mine = []
        for _ in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", "unknown", ""])
            mine.append((rng.choice([None, 0, 1, 2, 3, 5, 9]), role, rng.choice(["Yes.", "No!", "cut off", " \t", "", "Why?\n", "é ü", "Yes."])))
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want[conv] = plain(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        rows += [(conv, *r) for r in rng.sample(mine, len(mine))] or [(conv, None, None, None)]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_long_conversation_in_blocks(spark):
    """Blocks don't change the result, and no block's search sees more than its rows."""
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", f"row {i}."])) for i in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small, large = (repair.repair(table, block).collect() for block in (16, 4000))
    assert small == large and len(small[0].audit) >= 3000


def test_heuristic_never_exceeds_and_never_falls_faster_than_cost():
    rows = [repair.Row("user", "x", f) for f in ("", "blank", "truncated", "duplicate", "")]
    rest = repair.rest_costs(rows)
    assert rest == [6, 6, 4, 2, 0, 0]
    assert all(rest[i] - rest[i + 1] <= repair.DELETE for i in range(5))


def test_edges(spark):
    rows = [(None, None, None, None, 1, "x"), (1, 0, "user", "Hi.", 1, "x"), (1, 0, "user", "Hi.", 2, "y"), (2, None, None, "no role.", 1, "x"), (3, 5, "user", None, 1, "x"), (4, -3, "assistant", "w " * 50_000 + ".", 1, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int, audit string")
    got = {r.conv_id: r for r in repair.repair(repair.damage(table)).collect()}
    assert set(got) == {None, 1, 2, 3, 4} and got[None].cost >= 0
    assert repair.repair(repair.damage(table.where("false"))).collect() == []
    # a conversation whose rows are all dropped: zeros, no audit, the hash of nothing
    gone = next(i for i in range(1000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repair(repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(40) for t in range(5)] + [(None, 1, None, None), (1, None, "user", None)]
    got = sorted(map(tuple, repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        made = {0: (None, None), 1: (role, ""), 2: (role, text.translate(str.maketrans("", "", ".!?"))), 4: ("user", text)}.get(kind, (role, text))
        want += [(c, t, *made)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    base = "/root/testdata/sf0.001"
    link = duckdb.connect()
    for name in ("conversations", "embeddings"):
        link.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    for name in ("op11_conversation_repair", "op13_vector_codes"):
        got = queries.QUERIES[name](spark, base)
        want = link.execute(queries.ORACLES[name]).fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
