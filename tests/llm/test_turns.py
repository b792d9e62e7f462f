import hashlib
import random
from collections import defaultdict

import pytest
from conftest import SF_DIR
from plain import CLASHES, damage, repaired, result

from hostweave.llm import queries, turns


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def by_conversation(rows):
    found = defaultdict(list)
    for conv, *rest in rows:
        found[conv].append(tuple(rest))
    return {c: (*(x := repaired(own))[:-1], sha(x[-1])) for c, own in found.items()}


def random_rows(rng, convs, length):
    texts = ["Yes.", "No!", "why", "", " \n", "Well?", "so\t", "Hm. "]
    roles = ["system", "user", "assistant", "tool", None, "", "superuser"]
    rows = []
    for conv in range(convs):
        odd = rng.random() < 0.5
        for turn in range(rng.randrange(length)):
            role = rng.choice(roles) if odd and rng.random() < 0.5 else ("assistant" if turn % 2 else "user")
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', '', '?', '. '])}"
            at = None if rng.random() < 0.05 else rng.choice([turn, turn, turn * 2])
            rows += [(conv, at, role, rng.choice([text, text, text, None]))] * rng.choice([1, 1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = by_conversation(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", sha([]))
    assert result(queries.op13_rank_convergence_repair(spark, SF_DIR)) == sorted(((c, *want.get(c, empty)) for c in {r[0] for r in rows}), key=repr)


@pytest.mark.parametrize("chunk", [4096, 3, 1])  # short chunks: many guesses, passes and stitches
def test_random_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rows = random_rows(random.Random(chunk), 120, 25)
    made = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r[0]: tuple(r)[1:] for r in turns.repair_conversations(made).collect()}
    assert found == by_conversation(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", 50)
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["same.", f"{i}", f"{i}."])) for i in range(3000)]
    rows += [(2, 0, "user", "again.")] * 500 + [(2, i, "user", "again.") for i in range(1, 400)] + [(2, 400, "assistant", "so.")]
    rows += [(3, i, "user", f"no end {i}") for i in range(700)]  # every row truncated
    made = spark.createDataFrame(rows, SCHEMA).repartition(16)
    found = {r[0]: tuple(r)[1:] for r in turns.repair_conversations(made).collect()}
    assert found == by_conversation(rows)
    lines = [f"{r.role}:{r.text}" for r in turns.repaired_turns(made).where("conv_id = '1'").orderBy("place").collect()]
    assert sha(lines) == found[1][-1]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (5, None, "user", "x" * 300_000), (5, None, "user", "x" * 300_000), (5, 2, "assistant", "!"), (7, 0, None, "\n")]
    kind = SCHEMA + ", " + ", ".join(f"c{i} string" for i in range(len(CLASHES)))
    names = ["conv_id", "turn", "role", "text", *CLASHES]
    made = spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows], kind).toDF(*names)
    assert {r[0]: tuple(r)[1:] for r in turns.repair_conversations(made).collect()} == by_conversation(rows)
    want = by_conversation(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", sha([]))
    assert result(turns.repaired_after_damage(made)) == sorted(((c, *want.get(c, empty)) for c in (None, 5, 7)), key=repr)
    assert turns.repaired_after_damage(made.limit(0)).collect() == [] == turns.repaired_turns(made.limit(0)).collect()


def test_costs_differ_by_a_constant_where_passes_meet():
    rng = random.Random(3)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 10, 12, 13, 14, 15]) for _ in range(rng.randrange(1, 30)))
        old, new = turns.END, tuple(turns.backward(bytes(rng.choice([0, 1, 2, 13]) for _ in range(5)), turns.END))
        assert turns.fixed_up(codes, old, turns.backward(codes, old), new) == turns.backward(codes, new)
