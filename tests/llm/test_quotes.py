from __future__ import annotations

import random
import re

from texts import SMALL

from ledgerlane.llm.quotes import linked
from ledgerlane.llm.tables import read, scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def key(body):
    return " ".join(re.findall(r"[^\W_]+", body.lower()))


def brute(rows):
    lines = []
    for conv, turn, _, text in rows:
        own = []
        for line in re.split("\r?\n", text or ""):
            marks = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            own.append((marks[0].count(">") if marks else 0, line[marks.end():] if marks else line))
        lines.append(own)
    said = {}
    for (conv, turn, *_), own in zip(rows, lines, strict=True):
        for level, body in own:
            if level == 0 and key(body) and conv is not None and turn is not None:
                said[conv, key(body)] = min(turn, said.get((conv, key(body)), turn))
    reply = {}
    for (conv, turn, *_), own in zip(rows, lines, strict=True):
        near = [(level, -said[conv, key(body)]) for level, body in own
                if level and turn is not None and (conv, key(body)) in said and said[conv, key(body)] < turn]
        if near:
            reply[conv, turn] = min([*near, reply.get((conv, turn), near[0])])
    out = []
    for (conv, turn, role, _), own in zip(rows, lines, strict=True):
        path = [turn]
        while (conv, path[0]) in reply:
            path.insert(0, -reply[conv, path[0]][1])
        text = "\n".join(body for level, body in own if level == 0)
        text = re.sub(r"(?:\n[ \t]*)+$", "", re.sub(r"^(?:[ \t]*\n)+", "", text))
        out.append((conv, turn, role, text, path[-2] if len(path) > 1 else None, len(path) - 1, path))
    return sorted(out, key=repr)


def check(spark, df):
    got = linked(df, scratch(spark, "t"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = got.select("conv_id", "turn", "role", "text", "reply_to", "depth", "reply_path").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_whole_small_table(spark):
    check(spark, read(spark, SMALL, "conversations"))


def test_nested_quotes(spark):
    rows = [
        (1, 0, "a", "How do I sort?\nAny language."), (1, 1, "b", "> how do I SORT?\n\nUse sorted."),
        (1, 2, "a", ">> How do I sort?\n> Use sorted.\n\nThanks!\n"), (1, 3, "c", "> > > How do I sort?\r\n>> Use sorted.\n> Thanks!\nFine"),
        (1, 4, "d", "> never said"), (2, 0, "a", "> Use sorted.\nOther talk"), (1, 5, "e", "no quotes"), (1, 6, "f", "> Fine\n> How do I sort?\nboth"),
    ]
    check(spark, spark.createDataFrame(rows, SCHEMA))


def test_random_threads(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(40):
            out = [f"{'> ' * rng.randrange(1, 4)}{rng.choice(said)}" for _ in range(rng.randrange(3)) if said]
            own = f"Line {rng.randrange(60)} of talk"
            said.append(own)
            rows.append((conv, turn, "u", "\n".join([*out, own])))
    check(spark, spark.createDataFrame(rows, SCHEMA))


def test_odd_rows_long_threads_and_no_rows(spark):
    rows = [(9, t, "u", (f"> step {t - 1}\n" if t else "") + f"step {t}") for t in range(150)]
    rows += [(None, 0, "u", "x"), (None, 1, "u", "> x"), (3, None, "u", "> y"), (4, 0, None, None), (4, 1, "u", ""), (4, 2, "u", ">"),
             (5, 0, "u", "same"), (5, 1, "u", "same"), (5, 2, "u", "> same"), (5, 2, "u", "> same"), (6, 0, "u", "> me\nme"), (7, 0, "u", "w " * 90_000), (7, 1, "u", "> " + "w " * 90_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as lines", "'x' as path", "2 as reply_to")
    check(spark, df)
    assert linked(df.limit(0), scratch(spark, "t")).count() == 0
