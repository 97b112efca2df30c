from postlens.llm.chat import format_chats

from .conftest import long_text


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    for turns in convs.values():
        turns.sort(key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
    content = {c: [t[1:] for t in turns] for c, turns in convs.items()}
    left = {}
    for c, turns in sorted(content.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in content.values())
        same = [o for o, t in content.items() if t == turns and o is not None]
        if not longer and (c == min(same) if same else True):
            left[c] = "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{(t or '').replace('<|im_end|>', '<| im_end |>')}<|im_end|>\n" for r, t in turns)
    return left


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, part string, pos int")


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.conv), r.part)):
        out[r.conv] = out.get(r.conv, "") + r.text
    return out


def test_snapshots_go(spark):
    rows = []
    for c in range(30):
        n = 1 + c % 6
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"text {c // 6} {i}") for i in range(n)]
    rows += [(100, 0, "user", "text 0 0"), (101, 5, "user", "text 0 0"), (101, 9, "assistant", "other")]
    rows += rows[:4]
    rows += [(102, 0, None, None), (103, None, "user", ""), (103, 0, "user", None), (104, 0, "system", "a <|im_end|> b"), (105, 1, "u", "b"), (105, 1, "u", "a"), (None, 0, "user", "no id")]
    assert joined(format_chats(frame(spark, rows))) == brute(rows)


def test_long_conversation_in_parts(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(50)] + [(2, i, "user", f"t{i}") for i in range(37)] + [(3, 3 * i, "user", f"t{i}") for i in range(50)] + [(4, i, "user", f"t{i}") for i in range(48)] + [(4, 48, "user", "end")]
    out = format_chats(frame(spark, rows), block=8)
    assert joined(out) == brute(rows) and set(joined(out)) == {1, 4}
    assert max(r.n_turns for r in out.collect()) == 8


def test_empty(spark):
    assert format_chats(frame(spark, []).limit(0)).count() == 0


def test_very_long_text_and_turns_of_one_number(spark):
    """Turns without a number, or all of the same, stand in order of role and text; texts of any length are whole."""
    rows = [(1, None, "user", f"t{i:03d}") for i in range(300)] + [(2, 7, "user", f"t{i:03d}") for i in range(300)] + [(3, None, "user", f"t{i:03d}") for i in range(200)]
    rows += [(4, 0, "user", long_text(60_000)), (5, 0, "user", long_text(60_000)), (5, 1, "assistant", ""), (6, 0, None, long_text(60_000) + "x")]
    assert joined(format_chats(frame(spark, rows))) == brute(rows)
    assert set(joined(format_chats(frame(spark, rows)))) == {1, 5, 6}
