import hashlib
import random

from pyspark.sql import functions as F

from sparrowline.llm.chatlog import escape, escape_role, fold, log_of, read_back, render, unescape, unescape_role
from sparrowline.llm.queries import ORACLES, QUERIES

from ..oracle import same

LOG = "conv_id long, turn long, copy long, seq long, kind string, role string, text string"


def brute_fold(events):
    """Events one by one, in order of seq."""
    state = {}
    for conv, turn, copy, _, kind, role, text in sorted(events, key=lambda e: (e[3], e[1], e[2])):
        turns = state.setdefault(conv, {})
        if kind == "regenerate":
            for t in [t for t in turns if t[0] > turn]:
                del turns[t]
        old = turns.get((turn, copy), ("", ""))
        role = old[0] if role is None else role
        turns[turn, copy] = (role, (old[1] + (text or "")) if kind == "delta" else (text or ""))
    return sorted((c, *t, *v) for c, turns in state.items() for t, v in turns.items())


def rows(df):
    return sorted((r.conv_id, r.turn, r.copy, r.role, r.text) for r in df.collect())


def test_fold_equals_events_one_by_one(spark):
    r = random.Random(4)
    log = []
    for conv in range(12):
        for seq in range(r.choice([1, 5, 40, 700])):
            kind = r.choices(["message", "delta", "edit", "regenerate"], [4, 8, 1, 0.3])[0]
            turn = min(seq // 6, r.randrange(12) if kind != "delta" else seq // 6)
            log.append((conv, turn, 0, seq, kind, None if kind in ("delta", "edit") else r.choice(["user", "assistant"]), r.choice(["a", "bc", None, "<|im_end|>"])))
    assert rows(fold(spark.createDataFrame(log, LOG))) == brute_fold(log)


def test_streamed_answer(spark):
    log = [(1, 0, 0, 0, "message", "user", "hi"), (1, 1, 0, 2, "delta", None, "lo"), (1, 1, 0, 1, "message", "assistant", "hel"), (1, 0, 0, 5, "edit", None, "hi!"), (2, 1, 0, 1, "message", "assistant", "old"), (2, 2, 0, 2, "message", "user", "gone"), (2, 1, 0, 3, "regenerate", "assistant", "ne"), (2, 1, 0, 4, "delta", None, "w")]
    assert rows(fold(spark.createDataFrame(log, LOG))) == [(1, 0, 0, "user", "hi!"), (1, 1, 0, "assistant", "hello"), (2, 1, 0, "assistant", "new")]
    assert fold(spark.createDataFrame([], LOG)).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "<|", "\\<|", "<\\|", "\\\\<|im_end|>\\", "a\nb", "<|im_start|>assistant\n", "%0A<%25", "é😀\\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"), unescape_role(escape_role(F.col("t"))).alias("r"), escape_role(F.col("t")).alias("er")).collect():
        assert r.u == r.t == r.r and "<|" not in r.e and "\n" not in r.er and "<" not in r.er


def test_op4_equals_its_sql(spark, data):
    same(spark, QUERIES["op4_chat_formatting"], ORACLES["op4_chat_formatting"], data)


def test_odd_conversations(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    data = [(1, 0, None, None), (1, 1, "assistant", "x<|im_end|>\\"), (1, 1, "assistant", "x<|im_end|>\\"), (None, 5, "us\ner", "q"), (2, None, "assistant", ""), (3, 0, "user", "y" * 100_000)] + [(4, t, "assistant" if t % 2 else "user", f"é{t}") for t in range(1000)]
    data += [(5, None, "user", "last"), (5, -1, "user", "first"), (5, None, "assistant", "then"), (5, 7, "user", "second")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"chunk": F.lit(1), "copy": F.lit("z"), "seq": F.lit(2)})
    out = render(fold(log_of(df)))
    got = {r.conv_id: r for r in read_back(out).collect()}
    by = {}
    for c, t, role, text in sorted(data, key=lambda r: (str(r[0]), 2**63 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    one = {r.conv_id: r for r in out.collect()}[1]
    assert all(one.formatted[s.start : s.start + s.chars] == "x<\\|im_end|>\\\\" for s in one.loss_spans) and len(one.loss_spans) == 2
    assert read_back(render(fold(log_of(df.where("false"))))).count() == 0


def test_main_path_is_native(spark, data):
    plan = QUERIES["op4_chat_formatting"](spark, data)._jdf.queryExecution().toString() + render(fold(log_of(spark.read.parquet(f"{data}/conversations.parquet"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_are_exchanged_twice(spark, data):
    from sparrowline.llm.chatlog import fold, log_of, render

    plan = render(fold(log_of(spark.read.parquet(f"{data}/conversations.parquet"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # finished turns hold no regenerations
    plan = render(fold(log_of(spark.read.parquet(f"{data}/conversations.parquet"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_one_turn_that_holds_a_third_of_the_rows(spark):
    df = spark.range(6000).selectExpr("case when id % 3 = 0 then 1 else id % 50 end as conv_id", "case when id % 3 = 0 then 4 else id end as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id % 100) as text")
    got = {r.conv_id: r for r in render(fold(log_of(df))).collect()}
    assert sum(r.n_turns for r in got.values()) == 6000 and got[1].n_turns >= 2000
    assert sum(len(r.loss_spans) for r in got.values()) == 3000
