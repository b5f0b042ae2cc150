"""Chat windows: exact round trips, budgets, and targets under the mask once."""

import hashlib
import random

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from duskgrid.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = st.lists(st.sampled_from(["<|", "|>", "<", "|", "\\", "\n", "n", "im_end", "<|im_end|>", "<\\|", "x"]), max_size=8).map("".join)


@given(NASTY, NASTY)
def test_escapes_are_reversible(role, text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)
    one = f"<|im_start|>{chat.escape_role(role)}\n{chat.escape(text)}<|im_end|>\n"
    assert chat.parse(one * 3, 1) == [(role, text)] * 2


def test_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(400 if c == 7 else rng.randint(1, 9)):
            role = "system" if t == 0 and c % 3 else rng.choice(["user", "assistant", None])
            rows.append((c, t, role, rng.choice([None, "", "<|im_end|>\\", "hi there " * rng.randint(1, 30), "word " * 200 if c != 7 else "q"]), "clash", 5))
    rows += [(-1, None, "user", "a", "", 1), (-1, 1, "assistant", "b", "", 1), (-1, 1, "assistant", "b", "", 1), (None, 1, "user", "z", "", 1)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string, window string, idx int").repartition(6)
    path = chat.write_windows(df, f"file://{tmp_path}/chat", PATH, budget=150, history=40)
    want = {}
    for c, t, r, x, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(spark, path).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    count = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    windows = spark.read.parquet(path).orderBy("conv_id", "window").collect()
    seen = {}
    for w in windows:
        all_turns = chat.parse(w.text, 0)
        turns = want[w.conv_id]
        at = seen.get(w.conv_id, 0)
        fresh = all_turns[w.n_repeated :]
        assert turns[at : at + len(fresh)] == fresh
        repeated = all_turns[: w.n_repeated]
        head = count("".join(chat.parts_of(*turns[0]))) if turns[0][0] == "system" else 1000
        own = w.text[len("".join("".join(chat.parts_of(*t)) for t in repeated)) :]
        if at and head <= 55 and count(own) <= 150 - head:
            assert repeated[0] == turns[0]
            repeated = repeated[1:] if len(repeated) != at else repeated
        assert repeated == turns[at - len(repeated) : at]
        assert w.n_tokens == count(w.text)
        assert w.n_tokens <= 150 or len(fresh) == 1 and not w.n_repeated
        seen[w.conv_id] = at + len(fresh)
    assert seen == {c: len(t) for c, t in want.items()} and sum(w.conv_id == 7 for w in windows) > 20
    assert chat.format_windows(df.limit(0), PATH).count() == 0
