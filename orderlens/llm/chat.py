"""Chat formatting with masks aligned by offsets.

A conversation is rendered as one text, encoded once with the place of each token, and the sorted spans of the trained turns are laid over the sorted spans of the
tokens by binary search. Markers are special tokens, so no token reaches from a turn's text into a marker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that never stand in an escaped text: our markers, and those of other templates and vocabularies.
CONTROLS = (TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "^"
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(r"\^(\^?)")
PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """Each escape sign is doubled, and one is put behind the first character of each control string."""
    return CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: Iterable[dict], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the sorted spans of its trained turns' texts."""
    parts, at, spans = [], 0, []
    for t in turns:
        head, body = f"{TURN}{escape(t['role'])}{TEXT}", escape(t["text"])
        if t["role"] == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def overlay(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the tokens inside it: the first, and the one after the last."""
    first = np.searchsorted(starts, [a for a, _ in spans], "left")
    last = np.searchsorted(ends, [b for _, b in spans], "right")
    return [(int(i), int(j)) for i, j in zip(first, last, strict=True) if j > i]


def format_conversations(turns: DataFrame, path: str, trained: str = "assistant", key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: key, formatted text, ids, loss_tokens and loss_chars.

    loss_tokens are runs of trained tokens (first, and after the last), loss_chars the same runs as code points of formatted; escapes are still in it.
    Turns go by turn number, ties by role and text; repeated rows are turns of their own. A null role or text is empty; a null turn comes first; rows with a null key are
    one conversation. Other columns are dropped, an empty table gives an empty one. A conversation is one record and must fit into a task.
    """
    kind = turns.schema[key].dataType.simpleString()
    grouped = turns.select(turns[key].alias("key"), F.struct(turns[turn].alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")).alias("t")).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def make():
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        library.add_special_tokens([TURN, TEXT, END])

        def work(b: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"key": b["key"], "formatted": [], "ids": [], "loss_tokens": [], "loss_chars": []}
            for turns_of in b["turns"]:
                formatted, spans = render(turns_of, trained)
                encoded = library.encode(formatted, add_special_tokens=False)
                offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
                runs = overlay(offsets[:, 0], offsets[:, 1], spans)
                out["formatted"].append(formatted)
                out["ids"].append(encoded.ids)
                out["loss_tokens"].append([{"start": i, "end": j} for i, j in runs])
                out["loss_chars"].append([{"start": int(offsets[i, 0]), "end": int(offsets[j - 1, 1])} for i, j in runs])
            return out

        return work

    spans = "array<struct<start:int,end:int>>"
    return map_rows(grouped, f"key {kind}, formatted string, ids array<int>, loss_tokens {spans}, loss_chars {spans}", make).withColumnRenamed("key", key)


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What stands in formatted conversations: turns (role and text, unescaped) and loss_text, all text under the mask, unescaped."""
    kind = formatted.schema[key].dataType.simpleString()

    def make():
        return lambda b: {
            "key": b["key"],
            "formatted": b["formatted"],
            "turns": [[{"role": unescape(r), "text": unescape(t)} for r, t in PARSE.findall(f)] for f in b["formatted"]],
            "loss_text": ["".join(unescape(f[s["start"] : s["end"]]) for s in spans) for f, spans in zip(b["formatted"], b["loss_chars"], strict=True)],
        }

    return map_rows(formatted.select(formatted[key].alias("key"), "formatted", "loss_chars"), f"key {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string", make).withColumnRenamed("key", key)
