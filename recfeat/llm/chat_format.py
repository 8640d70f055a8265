"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its
assistant texts are intersected with the token spans by binary search. Turn marks are added tokens, so
no token crosses from a mark into a text. Inside texts a backslash is doubled and ``<|`` becomes
``<\\|``; so a text can hold no mark, and ``unescape`` gives it back exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused_name

ROLES = ("system", "user", "assistant")
END = "<|end|>"
OTHER = "<|role|>"
TEXT = "<|text|>"
MARKS = (*(f"<|{r}|>" for r in ROLES), OTHER, TEXT, END)
_TURN = re.compile(r"<\|(?:(system|user|assistant)|role)\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn_end: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of its assistant texts (with their end marks if ``learn_end``)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"<|{role}|>" if role in ROLES else f"{OTHER}{escape(role)}{TEXT}"
        body = escape(text)
        parts += [head, body, END]
        start = at + len(head)
        at = start + len(body) + len(END)
        if role == "assistant" and (learn_end or body):
            spans.append((start, at if learn_end else start + len(body)))
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` got."""
    turns = []
    for m in _TURN.finditer(formatted):
        role, body = m[1], m[2]
        if role is None:
            role, _, body = body.partition(TEXT)
            role = unescape(role)
        turns.append((role, unescape(body)))
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span. ``offsets``: sorted (start, end) of each token; ``spans``: sorted, disjoint."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        starts, ends = np.array(spans).T
        first = np.searchsorted(offsets[:, 1], starts, side="right")
        last = np.searchsorted(offsets[:, 0], ends, side="left")
        for a, b in zip(first.tolist(), last.tolist()):
            mask[a:b] = True
    return mask


class Formatter:
    """Renders, encodes and masks conversations with a tokenizer file, to which the marks are added as tokens.

    Where a rank file of the same vocabulary (and its pattern) is given, it does the work, several times faster: a
    token's bytes are known by its id, so offsets are running sums. Both give equal ids and offsets (tested).
    """

    def __init__(self, tokenizer_path: str, learn_end: bool = False, ranks_path: str | None = None, pattern: str | None = None):
        self.learn_end, self.fast = learn_end, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            first = max(ranks.values()) + 2  # one id is the vocabulary's own special token's
            marks = {m: first + k for k, m in enumerate(MARKS)}
            self.fast = tiktoken.Encoding("marks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=marks)
            self.sizes = np.zeros(first + len(MARKS), dtype=np.int64)
            for token, n in [*ranks.items(), *((m.encode(), n) for m, n in marks.items())]:
                self.sizes[n] = len(token)
        else:
            from tokenizers import AddedToken, Tokenizer

            self.whole = Tokenizer.from_file(tokenizer_path)
            self.whole.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the (start, end) of each token in characters; a part of a character counts as the whole of it."""
        if self.fast is None:
            encoded = self.whole.encode(formatted, add_special_tokens=False)
            return np.array(encoded.ids, dtype=np.int64), np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
        ids = self.fast.encode_to_numpy(formatted, allowed_special="all").astype(np.int64)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if not formatted.isascii():
            points = np.frombuffer(formatted.encode("utf-32-le"), dtype=np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
            starts, ends = np.searchsorted(at, starts, side="right") - 1, np.searchsorted(at, ends, side="left")
        return ids, np.stack([starts, ends], axis=1)

    def __call__(self, turns: list[tuple[str, str]]) -> dict:
        formatted, spans = render(turns, self.learn_end)
        ids, offsets = self.encode(formatted)
        return {"formatted": formatted, "ids": ids, "offsets": offsets, "mask": token_mask(offsets, spans)}


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the loss mask, read back: one for each run of masked tokens, without end marks."""
    texts, edges = [], np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        run = formatted[offsets[a, 0] : offsets[b - 1, 1]]
        texts.append(unescape(run.removesuffix(END)))
    return texts


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def format_conversations(
    rows: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", learn_end: bool = False, ranks_path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """One row for each conversation: its formatted text, token ids, loss mask, and digests read back from these.

    Returns ``conv_col, formatted, ids, loss_mask`` and ``n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. ``learn_end`` puts the end mark of assistant turns under the mask too. Turns stand in the order of ``turn_col`` (nulls first), then role and text; a null
    text or role is empty. Repeated rows are turns of their own; rows with a null id form one
    conversation; an empty table gives no row; other columns are not read. A conversation is what is
    encoded whole, so one conversation must fit a task.
    """
    conv = unused_name(rows, "conv")
    turns = F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("t")
    )))
    grouped = rows.groupBy(F.col(conv_col).alias(conv)).agg(turns.alias("turns"))
    schema = T.StructType([
        T.StructField(conv_col, rows.schema[conv_col].dataType), T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Formatter(tokenizer_path, learn_end, ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if not batch.num_rows:
                    continue
                made = [make([(t["r"], t["t"]) for t in turns]) for turns in batch.column(1).to_pylist()]
                back = [read_back(x["formatted"]) for x in made]
                loss = ["".join(masked_text(x["formatted"], x["offsets"], x["mask"])) for x in made]
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([x["formatted"] for x in made], pa.string()), _lists([x["ids"] for x in made], pa.int32()),
                        _lists([x["mask"] for x in made], pa.bool_()), pa.array([len(b) for b in back], pa.int64()),
                        pa.array([sha("".join(f"{r}\n{t}\n" for r, t in b)) for b in back], pa.string()),
                        pa.array([len(x) for x in loss], pa.int64()), pa.array([sha(x) for x in loss], pa.string()),
                        pa.array([len(x["formatted"]) for x in made], pa.int64()),
                    ],
                    names=schema.names,
                )

    return grouped.mapInArrow(run, schema)
