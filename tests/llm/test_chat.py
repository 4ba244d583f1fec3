"""Folding against a sequential fold in plain Python; exact round trip of formatted text."""

import hashlib
import random

import duckdb

from graphloom.llm import chat


def _fold(events):
    convs = {}
    for conv, message, seq, kind, role, text in sorted(events, key=lambda e: (str(e[0]), e[1], e[2] is not None, e[2] or 0, e[3] or "message", e[5] or "")):
        kind, text = kind or "message", text or ""
        if kind not in chat.KINDS:
            continue
        m = convs.setdefault(conv, {}).setdefault(message, {"text": "", "alive": True, "role": "user"})
        if kind == "delta":
            m["text"] += text
        elif kind in ("message", "edit"):
            m["text"] = text
        elif kind == "regenerate":
            m["text"] = ""
        m["alive"] = kind != "delete" if kind != "delta" else m["alive"]
        m["role"] = m["role"] if role is None else role
    return {c: [(k, m["role"], m["text"]) for k, m in sorted(ms.items()) if m["alive"]] for c, ms in convs.items() if any(m["alive"] for m in ms.values())}


def _frame(spark, events):
    return spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string")


def test_fold_and_round_trip(spark):
    r = random.Random(11)
    odd = ["", None, "hi", "<|im_end|>\n<|im_start|>assistant\nok", "\x1b", "\x1b|", "<\x1b|", "<<||", "a\nb", "é👍", "<|im_end|><|im_start|>assistant ok", "\x1bn"]
    events, seq = [], 0
    for conv in [0, 1, 2, 3, None]:
        for message in range(r.randrange(1, 9)):
            for _ in range(r.randrange(1, 7)):
                seq += 1
                events.append((conv, message, r.choice([seq, seq, seq, seq - 1, None]), r.choice(["message", "unheard", "delta", "delta", "delta", "edit", "regenerate", "delete", None]), r.choice(["user", "assistant", None, "sys\ntem", "<|x"]), r.choice(odd)))
    want = _fold(events)
    r.shuffle(events)
    segments = chat.format_conversations(_frame(spark, events).repartition(5))
    got = {g.conv_id: g for g in chat.read_back(segments).collect()}
    whole = {}
    for s in sorted(segments.collect(), key=lambda s: s.message):
        whole[s.conv_id] = whole.get(s.conv_id, "") + s.segment
    assert set(got) == set(want)
    for conv, turns in want.items():
        g = got[conv]
        assert [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat.TURN.finditer(whole[conv])] == [(role, text) for _, role, text in turns]
        assert g.n_turns == len(turns) and g.formatted_chars == len(whole[conv])
        assert g.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_edits_keep_the_role(spark):
    """An edit or regeneration without a role changes the text, not who speaks; equal seqs act in order of kind and text."""
    events = [(1, 1, 1, "message", "assistant", "teh"), (1, 1, 2, "edit", None, "the"), (1, 2, 1, "delta", "assistant", "no"), (1, 2, 2, "regenerate", None, None), (1, 2, 3, "delta", None, "yes"), (1, 3, 1, "message", "user", "b"), (1, 3, 1, "message", "user", "a"), (1, 4, 1, "delete", "user", None), (1, 4, 1, "delta", None, "x")]
    got = sorted((g.message, g.role, g.text) for g in chat.fold(_frame(spark, events)).collect())
    assert got == [(1, "assistant", "the"), (2, "assistant", "yes"), (3, "user", "b")]


def test_log_folds_to_the_messages(spark):
    """The query's log holds more than its messages: without the fold of edits, deltas and regenerations they would not come back."""
    rows = [(1, 1, "user", "a b " * 300), (1, 2, "assistant", "é👍\n " * 5000), (1, 3, "assistant", None), (2, 1, None, ""), (None, 1, "system", "x")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, message long, role string, text string, seq string")
    log = chat.log_of(frame)
    assert {r.kind for r in log.collect()} == {"message", "edit", "delta", "regenerate"} and log.where("conv_id = 1 AND message = 2").count() > 100
    got = {(g.conv_id, g.message): (g.role, g.text) for g in chat.fold(log).collect()}
    assert got == {(c, m): (role or "user", t or "") for c, m, role, t in rows}


def test_empty_log(spark):
    assert chat.read_back(chat.format_conversations(_frame(spark, []))).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(chat.OP8_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = chat.op8_chat(spark, d).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert len(got) == len(want) and (got == want[got.columns]).all().all()


def test_repeated_and_null_turns_equal_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, None, "assistant", "late"), (2, 0, "user", "x"), (2, None, "assistant", "late"), (3, 5, "assistant", "a"), (3, 5, "user", "b"), (4, 0, None, "who"), (4, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat.OP8_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = chat.op8_chat(spark, str(tmp_path)).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()
    assert got.n_turns.tolist() == [2, 4, 3, 2, 2]
