import hashlib
import random

import numpy as np

from quietlog.llm import chat
from quietlog.llm.encoding import default_file

FILE = default_file("byte_bpe_50k.json")
PARTS = ["<|turn|>", "<|end|>", "<|text|>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "|", ">", "<|end|", " ", "\n", "é", "🙂", "ok", "<\\|end|>", ""]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        turns = [("".join(rng.choices(PARTS, k=2)), text), ("assistant", text[::-1])]
        line, spans = chat.render(turns)
        assert chat.parse(line) == turns
        assert [chat.unescape(line[a:b]) for a, b in spans][-1] == text[::-1]


def test_mask_takes_exactly_the_learnt_texts():
    rng = random.Random(2)
    code = chat.tokenizer(FILE)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PARTS, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 6))]
        line, spans = chat.render(turns)
        offsets = np.array(code.encode(line, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        mask = chat.token_mask(offsets, spans)
        assert chat.masked_text(line, offsets, mask) == "".join(t for r, t in turns if r == "assistant")
        assert [bool(m) for m in mask] == [any(a < e and b > s for s, e in spans) for a, b in offsets]


def test_digests_with_nulls_ties_and_long_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "</s>"), (3, 5, "assistant", "z"), (3, 5, "assistant", "y"),
            (3, 5, "assistant", "y"), (None, 0, "user", "q"), (None, 1, "assistant", "[INST]"), (5, 0, "assistant", "long text. " * 30_000)]
    rows += [(6, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(2000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(frame, FILE)).collect()}
    assert len(got) == 6
    for conv in got:
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[conv]["formatted_chars"] == sum(23 + len(chat.escape(r)) + len(chat.escape(x)) for _, r, x in own)
    assert chat.digests(chat.formatted(frame.where("false"), FILE)).count() == 0
