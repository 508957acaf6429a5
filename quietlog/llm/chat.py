"""Chat formatting with a loss mask aligned by offsets.

A turn is ``<|turn|>role<|text|>text<|end|>``.  In roles and texts a backslash is doubled and
control strings get a backslash behind their first character, so no control string survives in
them and dropping the backslashes gives the original back.  The three marks are added to the tokenizer
as special tokens; therefore no token reaches across the border of a text.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import column

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning in this template or in common ones.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|startoftext|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learnt: str = "assistant") -> tuple[str, np.ndarray]:
    """(formatted conversation, spans of the learnt texts in it), for (role, text) pairs."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        parts += [head, body, END]
        if role == learnt:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def tokenizer(file: str):
    """The tokenizer of ``file`` with the template's marks as special tokens."""
    from tokenizers import AddedToken, Tokenizer
    code = Tokenizer.from_file(file)
    code.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
    return code


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: both are sorted, so one binary search finds each token's span."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], "right")  # the first span that ends behind the token's start
    near = np.minimum(at, len(spans) - 1)
    return (at < len(spans)) & (offsets[:, 1] > spans[near, 0]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped characters under the mask, read from the tokens' offsets.

    Tokens that share a character (bytes of one code point) overlap; each character counts once.
    """
    begin, end = offsets[mask].T
    reach = np.maximum.accumulate(end)
    begin = np.maximum(begin, np.concatenate([[0], reach])[:-1])
    new = end > begin
    begin, end = begin[new], end[new]
    apart = np.ones(len(begin) + 1, bool)  # whether a run ends before each token
    apart[1:-1] = begin[1:] != end[:-1]
    return "".join(unescape(formatted[x:y]) for x, y in zip(begin[apart[:-1]].tolist(), end[apart[1:]].tolist()))


SCHEMA = "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask binary, loss_text string"


def formatted(conversations: DataFrame, file: str) -> DataFrame:
    """One row per conversation: the formatted text, its ids and loss mask (a byte per id).

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one
    order; a null role or text is an empty one; rows without conv_id form one conversation
    without conv_id.  Assistant texts are learnt.  Rows are sorted by conversation in their
    partition and one conversation is held at a time: it is one string of the output.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        code = tokenizer(file)

        def out(group):
            lines = [render(turns) for _, turns in group]
            found = []
            for (conv, turns), (line, spans), code_of in zip(group, lines, code.encode_batch([x for x, _ in lines], add_special_tokens=False)):
                offsets = np.array(code_of.offsets, np.int64).reshape(-1, 2)
                mask = token_mask(offsets, spans)
                found.append((conv, len(turns), line, code_of.ids, mask.tobytes(), masked_text(line, offsets, mask)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)],
                ["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_text"])

        group, size, none = [], 0, object()
        last = none
        for batch in batches:
            for conv, role, text in zip(*(column(batch, c) for c in ("conv_id", "role", "text"))):
                if last is none or conv != last:
                    if size > 1 << 20:
                        yield out(group)
                        group, size = [], 0
                    group.append((conv, []))
                    last = conv
                group[-1][1].append((role, text))
                size += len(text) + 64
        if group:
            yield out(group)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted text and mask."""
    import hashlib

    def run(batches):
        for batch in batches:
            lines, losses = column(batch, "formatted"), column(batch, "loss_text")
            turns = [parse(x) for x in lines]
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("conv_id")), pa.array([len(t) for t in turns], pa.int64()),
                pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns]),
                pa.array([len(x) for x in losses], pa.int64()), pa.array([sha(x) for x in losses]),
                pa.array([len(x) for x in lines], pa.int64()),
            ], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "loss_text").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
