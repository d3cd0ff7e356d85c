"""Event logs folded and rendered, against a sequential fold; template read back."""

import hashlib
import random

import pytest

from cohortloom.llm import chat

EVENTS = "conv_id long, seq long, msg long, kind string, role string, text string, size int, opened string"
ODD = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s><s>", "[", "[\\/INST]", "<", "plain", "a\nb\r\n\n", "\\", "\\n", "über 😀 </s", "/s>", "s>", "[/INST", "</s>" * 50, "x" * 300_000 + "<s>"]


def plain(events):
    """Messages of each conversation by going through its events one after another."""
    out = {}
    # null seqs first, then by seq, kind, role (null first) and text (null first)
    order = lambda e: (e[1] is not None, e[1] or 0, chat.KINDS.index(e[3]), e[4] is not None, (e[4] or "").encode(), e[5] is not None, (e[5] or "").encode())
    for conv, seq, msg, kind, role, text in sorted(events, key=order):
        said = out.setdefault(conv, [])
        own = [m for m in said if m["msg"] == msg]
        if kind == "message" or not own:
            said.append({"msg": msg, "opened": seq, "role": role or "", "text": "" if kind == "regenerate" else text or "", "gone": False, "nth": len(own)})
        else:
            own[-1]["text"] = {"regenerate": "", "edit": text or "", "delta": own[-1]["text"] + (text or "")}[kind]
        if kind == "regenerate" and seq is not None:
            start = ([m for m in said if m["msg"] == msg])[-1]["opened"]
            for m in said:
                if start is not None and m["opened"] is not None and start < m["opened"] < seq:
                    m["gone"] = True
    key = lambda m: (m["opened"] is not None, m["opened"] or 0, m["msg"] is not None, m["msg"] or 0, m["nth"])
    return {c: [(m["role"], m["text"]) for m in sorted(said, key=key) if not m["gone"]] for c, said in out.items()}


def logs(seed, seqs, conversations=12):
    rng = random.Random(seed)
    events = []
    for conv in [None, *range(conversations)]:
        for _ in range(rng.randrange(1, 60)):
            kind = rng.choice(["message", "message", "message", "delta", "delta", "edit", "regenerate"])
            events.append((conv, rng.choice(seqs), rng.choice([None, *range(12)]), kind, rng.choice(["user", "assistant", None, "tool\nx\\"]), rng.choice(ODD[:-2])))
    return events


def shown(rendered):
    return {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rendered.select("conv_id", chat.turns(chat.formatted(chat.F.col("segments"))).alias("turns")).collect()}


@pytest.mark.parametrize("seqs", [[None, *range(40)], [i * 3000 for i in range(40)], [-(10**15) + i * 10**9 for i in range(25)]])
def test_logs_fold_as_one_event_after_another(spark, seqs):
    events = logs(len(seqs), seqs)
    df = spark.createDataFrame([(*e, 1, "x") for e in events], EVENTS)
    want = {c: m for c, m in plain(events).items() if m}
    assert shown(chat.render(chat.reconstruct(df))) == want


def test_streamed_edited_and_regenerated(spark):
    events = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "llo"),
        (1, 5, 2, "message", "user", "and?"), (1, 6, 3, "message", "assistant", "lost"), (1, 7, 1, "regenerate", None, None), (1, 8, 1, "delta", None, "hey"),
        (1, 9, 0, "edit", None, "hi!"), (1, 10, 4, "message", "user", "bye"), (1, 11, 3, "delta", None, " late"),
    ]
    df = spark.createDataFrame([(*e, 1, "x") for e in events], EVENTS)
    assert shown(chat.render(chat.reconstruct(df))) == {1: [("user", "hi!"), ("assistant", "hey"), ("user", "bye")]}
    with pytest.raises(Exception, match="unknown kind"):
        chat.reconstruct(spark.createDataFrame([(1, 1, 1, "other", "user", "x", 1, "x")], EVENTS)).collect()


def test_texts_come_back_and_the_mask_covers_answers(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((r, x) for x in ODD for r in ("user", "assistant", "a\nb", None, "[/INST]", "\\\n\\n"))]
    rows += [(7, 0, "assistant", "same"), (7, 0, "assistant", "same"), (7, None, "user", "first"), (None, 1, None, None), (8, 0, "system", "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    rendered = chat.render(chat.reconstruct(chat.events_of_turns(df)))
    found = {r.conv_id: r for r in chat.digests(rendered).collect()}
    whole = {r.conv_id: r for r in rendered.collect()}
    assert set(found) == {0, 1, 2, 7, 8, None}
    for conv, r in found.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        learned = "".join(x[3] for x in own if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        text = "".join(s.text for s in whole[conv].segments)
        assert r.formatted_chars == len(text)
        marks = sum(text.count(m) for m in ("<s>", "</s>", "[INST]", "[/INST]"))
        assert marks == 2 * len(own)


def test_empty_log(spark):
    assert chat.digests(chat.render(chat.reconstruct(spark.createDataFrame([], EVENTS)))).collect() == []


def test_plain_logs_are_not_searched_for_regenerations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = chat.reconstruct(chat.events_of_turns(turns))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_long_conversation_is_dealt_out(spark):
    """100,000 messages of one conversation with regenerations: spans, not the conversation, meet in a window."""
    n = 100_000
    df = spark.range(n).selectExpr(
        "1L AS conv_id", "id AS seq", "id - (id % 10 = 9)::int * 5 AS msg", "if(id % 10 = 9, 'regenerate', 'message') AS kind", "'user' AS role", "cast(id AS string) AS text")
    rows = chat.reconstruct(df).select("msg").collect()
    # of ten events the last takes back the four behind the message five before it
    assert sorted(r.msg for r in rows) == [i for i in range(n) if i % 10 <= 4]
