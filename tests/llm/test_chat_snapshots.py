import random

from tidemark.llm.chat_snapshots import maximal_conversations, turn_bytes

SCHEMA = "conv_id long, turn long, role string, text string, hash string"


def brute(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v)
    seqs = {c: [(r, x) for _, r, x in sorted(own, key=lambda v: tuple(map(low, v)))] for c, own in convs.items()}
    out = {}
    for c, own in seqs.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in seqs.values())
        equal = [k for k, o in seqs.items() if o == own]
        if not longer and c == min(equal):
            text = "".join(f"<|im_start|>{'unknown' if r is None else r}\n{x or ''}<|im_end|>\n" for r, x in own)
            out[c] = (len(own), len(equal), text)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab"), "extra"))
    rows += [(200, 0, None, None, ""), (201, 0, None, "", ""), (202, 0, "", None, ""), (203, 0, None, None, ""), (203, 1, "user", "é", ""), (None, 0, "user", "lost", "")]
    rows += [(204, 1, "user", "tie b", ""), (204, 1, "user", "tie a", ""), (204, None, "system", "first", ""), (205, 0, "user", "again", ""), (205, 0, "user", "again", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["text"]) for r in maximal_conversations(df).collect()}
    assert got == brute(rows)


def test_a_common_first_turn_and_a_long_conversation(spark):
    rows = [(c, 0, "user", "hello", "") for c in range(300)] + [(7, t, "user", f"turn {t}", "") for t in range(1, 800)]
    got = maximal_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(7, 800)]


def test_empty_table_and_turn_bytes(spark):
    assert maximal_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len({turn_bytes(*x) for x in ((None, None), ("", None), (None, ""), ("", ""), ("a", "b"), ("ab", ""), ("", "ab"))}) == 7


def test_very_long_texts_and_clashing_names(spark):
    text = "x" * 2_000_000
    rows = [(1, 0, "user", text, "h", 1), (2, 0, "user", text, "h", 2), (2, 1, "user", text + "y", "h", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hash string, n_turns int")
    got = maximal_conversations(df).collect()
    assert [(r["conv_id"], r["n_turns"], r["n_equal"]) for r in got] == [(2, 2, 1)] and text + "y" in got[0]["text"]
