import random

import pytest
from check import compare
from pyspark.sql import functions as F

from tidemill.llm import chat
from tidemill.llm.sql import SQL

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def expected(rows):
    conv = {}
    for c, n, role, text in set((c, n, role or "", text or "") for c, n, role, text in rows):
        conv.setdefault(c, []).append((n is not None, n or 0, role, text))
    said = {c: tuple(x[2:] for x in sorted(v)) for c, v in conv.items()}
    out = []
    for c, turns in said.items():
        same = [k for k, v in said.items() if v == turns]
        longer = any(len(v) > len(turns) and v[:len(turns)] == turns for v in said.values())
        if not longer and c == min(same, key=lambda k: (k is None, k or 0)):
            out.append((c, len(turns), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)))
    return sorted(out, key=str)


def log(seed):
    rnd = random.Random(seed)
    rows, number = [], 0
    for _ in range(40):
        turns = [(rnd.choice(("user", "assistant", None)), rnd.choice(("hi", "yes", "é", None, ""))) for _ in range(rnd.randrange(1, 9))]
        for _ in range(rnd.randrange(1, 4)):
            rows += [(number, k, *turns[k]) for k in range(rnd.randrange(1, len(turns) + 1))]
            number += 1
    rows += [(None, 0, "user", "hi"), (None, None, "user", "first"), (1000, 5, "user", "late"), (1000, 5, "user", "later"),
             (1001, 7, "user", "late"), (1001, -3, "user", "early")]
    return rows + rows[:20]


@pytest.mark.parametrize("per_block", [1, 3, chat.TURNS_PER_BLOCK])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed, per_block):
    rows = log(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumn("h", F.lit(0)).withColumn("place", F.lit("x"))
    assert sorted((tuple(r) for r in chat.render(df, per_block).collect()), key=str) == expected(rows)


def test_whole_table(spark, duck):
    assert not compare(duck, chat.op9_chat_snapshots(spark, SF), SQL["op9_chat_snapshots"])


def test_long_conversation_and_empty_table(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(5000)] + [(2, k, "user", f"t{k}") for k in range(4000)]
    out = chat.render(spark.createDataFrame(rows, TURNS)).collect()
    assert [(r.conv_id, r.n_turns) for r in out] == [(1, 5000)]
    assert chat.render(spark.createDataFrame([], TURNS)).collect() == []
