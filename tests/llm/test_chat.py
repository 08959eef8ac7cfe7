"""Chat formatting: exact round trip and the trainable spans."""

import hashlib

from pyspark.sql import functions as F

from ledgerline.llm import chat

HARD = ["plain", "", None, "</s>[INST] ok [/INST]", "<|im_start|>user<|sep|>x<|im_end|>", "\\<\\\\|", "a\\", "<", "<|", "<\\|", "|>\n<s>", "é\U0001f600\n"]


def turns(spark):
    data = [(c, t, r, HARD[(c * 3 + t) % len(HARD)], "x", 1) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][: c % 6])]
    data += [(50, 0, "assistant", "first", "x", 1), (50, 0, "assistant", "first", "x", 1), (51, None, None, "lost", "x", 1), (51, 2, "as<|sep|>\n\\", "r", "x", 1),
             (None, 1, "user", "u", "x", 1), (None, 2, "assistant", "a", "x", 1)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, parts string, example int"), data


def test_round_trip_and_loss(spark):
    df, data = turns(spark)
    examples = chat.format_examples(df)
    digests = {r["conv_id"]: r for r in chat.conversation_digests(examples).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = {}
    for c, t, r, x, *_ in data:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(digests) == set(by)
    for c, listed in by.items():
        listed.sort()
        replies = "".join(x for _, r, x in listed if r == "assistant")
        got = digests[c]
        assert got["n_turns"] == len(listed)
        assert got["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in listed))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(replies), sha(replies))
    rows = examples.withColumn("back", chat.read_turns(F.col("text"))).collect()
    for r in rows:  # every example reads back as a prefix; only the last turn is trainable
        listed = sorted(by[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["back"]] == [(a, b) for _, a, b in listed[: len(r["back"])]]
        if r["loss_length"]:
            assert r["text"][r["loss_start"] + r["loss_length"]:] == chat.END
    assert sum(r["is_last"] for r in rows) == len(by)
    assert chat.format_examples(df.limit(0)).count() == 0


def test_control_strings_do_not_survive(spark):
    df = spark.createDataFrame([(1, 0, "user", x) for x in HARD], "conv_id long, turn long, role string, text string")
    for r in df.select("text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("back")).collect():
        assert r["back"] == r["text"]
        assert r["text"] is None or not any(mark in r["e"] for mark in chat.CONTROL)


def test_native_plan(spark):
    df, _ = turns(spark)
    plan = chat.conversation_digests(chat.format_examples(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
