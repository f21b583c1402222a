"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, in turn order, by a template whose marks are special tokens of the tokenizer. It is encoded
once, with offsets; tokens under the loss mask are found by binary search of the token spans in the sorted spans of the
assistant's texts. Rows reach a worker sorted by conversation and turn and are streamed: a conversation longer than
SEGMENT_CHARS is handled in segments that end between turns, which changes no token, as no token crosses a mark, so memory
doesn't grow with a conversation.

Control strings in roles and texts are escaped reversibly: \\ becomes \\\\, <| becomes <\\| and, in roles, a line end \\n.

Defined results: a null role or text counts as empty; turns that tie are ordered by role, then text, nulls first; repeated
rows are repeated turns; rows of the null id form one conversation; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import arrow_schema, record, ship

TURN, END = "<|turn|>", "<|end|>"
SEGMENT_CHARS = 1 << 20
LOSS_ROLE = "assistant"

FORMATTED = "conv_id long, segment long, n_turns long, formatted string, ids array<int>, loss array<boolean>, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The rendered turns (role, text), and the starts and ends of the texts that bear loss."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head = f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
        body = escape(text)
        if role == LOSS_ROLE:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """render() read back."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        head, body = piece.split("\n", 1)
        if not body.endswith(f"{END}\n"):
            raise ValueError("a turn isn't ended")
        turns.append((unescape(head), unescape(body[: -len(END) - 1])))
    return turns


def loss_mask(spans: np.ndarray, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens overlap a loss span, and the characters they cover there, as the starts and ends of runs.

    spans: (tokens, 2) offsets. Tokens that are parts of one character have its offsets.
    """
    begin, stop = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    mask = np.zeros(len(spans), bool)
    # the tokens of each span: from the first that ends behind its start to the last that starts before its end
    first = np.searchsorted(spans[:, 1], begin, side="right")
    n = np.maximum(np.searchsorted(spans[:, 0], stop, side="left") - first, 0)
    span = np.repeat(np.arange(len(begin)), n)
    token = np.repeat(first - np.concatenate((np.zeros(1, np.int64), np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else span
    mask[token] = True
    lo, hi = np.maximum(spans[token, 0], begin[span]), np.minimum(spans[token, 1], stop[span])
    if not len(lo):
        return mask, lo, hi
    hi = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = (span[1:] != span[:-1]) | (lo[1:] > hi[:-1])
    return mask, lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([TURN, END])
    return t


def format_chats(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each segment of each conversation: rendered text, token ids, loss mask, and the characters under the mask.

    conversations: conv_id, turn, role, text. A conversation's rows stand together, in order, in one partition.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.col(c).cast("string") for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ship(rows.sparkSession)
    schema = arrow_schema(FORMATTED)

    def segment(conv: int | None, number: int, turns: list[tuple[str, str]]) -> dict:
        text, starts, ends = render(turns)
        e = tokenizer(path).encode(text, add_special_tokens=False)
        mask, lo, hi = loss_mask(np.array(e.offsets, np.int64).reshape(-1, 2), starts, ends)
        return {"conv_id": conv, "segment": number, "n_turns": len(turns), "formatted": text, "ids": np.array(e.ids, np.int32), "loss": mask, "loss_starts": lo, "loss_ends": hi}

    def run(batches):
        conv, number, turns, chars, any_yet, out, held = None, 0, [], 0, False, [], 0

        def ended() -> pa.RecordBatch:
            b = record({c: [x[c] for x in out] for c in schema.names}, schema)
            out.clear()
            return b

        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                role, text = role or "", text or ""
                if turns and (c != conv or chars + len(text) > SEGMENT_CHARS):
                    out.append(segment(conv, number, turns))
                    held += chars
                    number, turns, chars = number + 1, [], 0
                if not any_yet or c != conv:
                    conv, number, any_yet = c, 0, True
                turns.append((role, text))
                chars += len(text) + len(role) + len(TURN) + len(END) + 2
                if held > 4 * SEGMENT_CHARS:
                    yield ended()
                    held = 0
        if turns:
            out.append(segment(conv, number, turns))
        if out:
            yield ended()

    return rows.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what format_chats' rows hold, read back from them: they must be in its order and partitions."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    schema = arrow_schema(names)

    def run(batches):
        state, out = None, []

        def close() -> None:
            if state:
                out.append({**state, "turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})

        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("conv_id", "segment", "formatted", "ids", "loss", "loss_starts", "loss_ends")}
            # ids and mask stay in their flat buffers
            tokens = np.diff(col["ids"].offsets.to_numpy())
            borne = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(col["loss"].values.to_numpy(zero_copy_only=False), dtype=np.int64)))[col["loss"].offsets.to_numpy()])
            rows = zip(*(col[c].to_pylist() for c in ("conv_id", "segment", "formatted", "loss_starts", "loss_ends")), tokens.tolist(), borne.tolist(), strict=True)
            for x in (dict(zip(("conv_id", "segment", "formatted", "loss_starts", "loss_ends", "tokens", "borne"), r, strict=True)) for r in rows):
                if x["segment"] == 0:
                    close()
                    state = {k: 0 for k in schema.names} | {"conv_id": x["conv_id"], "turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()}
                turns = parse(x["formatted"])
                state["n_turns"] += len(turns)
                state["turns_sha256"].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                lost = "".join(unescape(x["formatted"][i:j]) for i, j in zip(x["loss_starts"], x["loss_ends"], strict=True))
                state["loss_chars"] += len(lost)
                state["loss_sha256"].update(lost.encode())
                state["formatted_chars"] += len(x["formatted"])
                state["n_tokens"] += x["tokens"]
                state["n_loss_tokens"] += x["borne"]
            if len(out) > 1000:
                yield record({c: [r[c] for r in out] for c in schema.names}, schema)
                out.clear()
        close()
        if out:
            yield record({c: [r[c] for r in out] for c in schema.names}, schema)

    return formatted.mapInArrow(run, names)


def op4(conversations: DataFrame) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", own), (-7, 1, LOSS_ROLE, own)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return digest(format_chats(rows)).drop("n_tokens", "n_loss_tokens")


_LEN = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '<|', ''))) // 2"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', '', '' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', '', '')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + {_LEN.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_LEN.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
