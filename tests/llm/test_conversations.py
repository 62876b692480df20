"""Snapshots against a plain model."""

import random

from roadloom.llm import conversations as c


def model(rows, piece_turns=c.PIECE_TURNS):
    chats = {}
    order = lambda r: tuple((v is not None, v if v is not None else 0) if i == 0 else (v is not None, (v or "").encode()) for i, v in enumerate(r))
    for conv, *turn in {r[:4] for r in rows}:
        if conv is not None:
            chats.setdefault(conv, []).append(tuple(turn))
    keys = {conv: tuple((r, t) for _, r, t in sorted(turns, key=order)) for conv, turns in chats.items()}
    inner = {k[:n] for k in keys.values() for n in range(len(k))}
    out = []
    for k in set(keys.values()) - inner:
        owners = [conv for conv, own in keys.items() if own == k]
        for i in range(0, len(k), piece_turns):
            text = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in k[i : i + piece_turns])
            out.append((min(owners), i // piece_turns, len(k), len(owners), text))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        script = rng.randint(0, 5)
        for turn in range(rng.randint(1, 12)):
            text = f"{script} {turn}" if turn < 6 or rng.random() < 0.7 else f"{rng.random()}"
            rows.append((conv, turn + (conv % 3), rng.choice(["user"]) if turn % 2 == 0 else "assistant", text, "x", 1))
    rows += rows[:20]
    rows += [(None, 1, "user", "lost", "x", 1), (70, None, None, None, "x", 1), (71, None, None, "", "x", 1), (72, 1, "user", "tie b", "x", 1), (72, 1, "user", "tie a", "x", 1),
             (73, 1, "", None, "x", 1), (74, 1, None, "", "x", 1)]
    rows += [(80, i, "user" if i % 2 else "assistant", f"long {i}", "x", 1) for i in range(3000)] + [(81, i, "user" if i % 2 else "assistant", f"long {i}", "x", 1) for i in range(2000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, place string, n_turns int"


def test_formatted_equals_the_model(spark):
    for seed in (1, 2):
        rows = made(seed)
        turns = spark.createDataFrame(rows, SCHEMA)
        assert sorted(map(tuple, c.formatted(turns).collect())) == model(rows)
    assert sorted(map(tuple, c.formatted(turns, 7).collect())) == model(rows, 7)


def test_one_conversation_over_many_partitions(spark):
    """Places and hashes are carried from range to range."""
    rows = [(conv, i, "user", f"turn {i}", "x", 1) for conv, n in ((1, 5000), (2, 4999), (3, 5000)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, SCHEMA)
        assert [tuple(r) for r in c.maximal_conversations(c.placed_turns(turns)).collect()] == [(1, 5000, 2)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty_table(spark):
    assert c.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
