"""Chat formatting with a grammar round trip: what is rendered parses back to its turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

START, END = "<|im_start|>", "<|im_end|>"
NEWLINE = "<|newline|>"  # stands for a line break inside a role
_HIDDEN = re.compile(r"<(\\*)\|(im_start|im_end|newline)\|>")
_SHOWN = re.compile(r"<\\(\\*)\|(im_start|im_end|newline)\|>")

# turn    := START role "\n" content END "\n"
# role    := text without START, END or line break
# content := text without START or END
# Inside role and content, control strings carry backslashes after "<", one more than in the source.


def escaped(text: str) -> str:
    return _HIDDEN.sub(r"<\1\\|\2|>", text)


def unescaped(text: str) -> str:
    return _SHOWN.sub(r"<\1|\2|>", text)


class Parser:
    """Deterministic parser of the grammar; takes the formatted text in parts of any size."""

    def __init__(self):
        self.rest = ""

    def feed(self, part: str) -> Iterator[tuple[str, str, int, int]]:
        """Finished turns as (role, text, from, to): the content's place within the turn's own text."""
        self.rest += part
        while True:
            line = self.rest.find("\n", len(START))
            end = self.rest.find(END + "\n", line + 1) if line >= 0 else -1
            if end < 0:
                return
            turn = self.rest[:end]
            if not turn.startswith(START) or START in turn[len(START):] or END in turn:
                raise ValueError("not a formatted conversation")
            self.rest = self.rest[end + len(END) + 1:]
            role = unescaped(turn[len(START):line].replace(NEWLINE, "\n"))
            yield role, unescaped(turn[line + 1:]), line + 1, end

    def close(self) -> None:
        if self.rest:
            raise ValueError("unfinished turn")


def _parsed(rendered: str) -> list[tuple[str, str]] | None:
    parser = Parser()
    try:
        turns = [(role, text) for role, text, _, _ in parser.feed(rendered)]
        parser.close()
    except ValueError:
        return None
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn as it is, or with role, then content escaped, until it parses back to the source.

    Once both are escaped the turn holds no control string but its own, so the search ends there.
    """
    hidden = escaped(role).replace("\n", NEWLINE)
    for as_role, as_text in ((role, text), (role, escaped(text)), (hidden, escaped(text))):
        rendered = f"{START}{as_role}\n{as_text}{END}\n"
        if _parsed(rendered) == [(role, text)]:
            return rendered
    raise ValueError("turn cannot be rendered")


@F.pandas_udf(StringType())
def _rendered(roles: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([render_turn(r or "", t or "") for r, t in zip(roles, texts)], dtype=object)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn with its part of the formatted text: conv_id, turn, role, text, rendered.

    A conversation's text is its parts in the order of turn, then role, then text. Null roles and texts
    count as empty; repeated rows are turns of their own; a null conv_id is one conversation, a null turn
    comes first; extra columns are not read. Rendering needs no grouping, so long conversations are spread.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                        _rendered(role, text).alias("rendered"))


def _read(loss_role: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key, began = None, None, False

        def row():
            state["parser"].close()
            return {"conv_key": key, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss"],
                    "loss_sha256": state["masked"].hexdigest(), "formatted_chars": state["chars"]}

        for batch in batches:
            out = []
            for conv, part in zip(batch["conv_key"], batch["rendered"]):
                if not began or conv != key:
                    if began:
                        out.append(row())
                    key, began = conv, True
                    state = {"parser": Parser(), "n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                state["chars"] += len(part)
                for role, text, _, _ in state["parser"].feed(part):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        state["loss"] += len(text)
                        state["masked"].update(text.encode())
            if out:
                yield pd.DataFrame(out)
        if began:
            yield pd.DataFrame([row()])
    return read


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Parse each conversation's formatted text again: one row per conversation.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Only the rendered
    parts are read. A conversation's digest runs over its turns in order, so they pass through one task,
    as a stream of which one turn is held at a time.
    """
    kind = formatted.schema["conv_id"].dataType
    parts = formatted.select(F.col("conv_id").cast("string").alias("conv_key"), "turn", "role", "text", "rendered")
    ordered = parts.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text").select("conv_key", "rendered")
    read = ordered.mapInPandas(
        _read(loss_role), "conv_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.select(F.col("conv_key").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def loss_spans(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The mask over each part: (conv_id, turn, rendered, lo, hi), code points, end exclusive; empty for other roles."""

    @F.pandas_udf("lo int, hi int")
    def spans(parts: pd.Series) -> pd.DataFrame:
        out = []
        for part in parts:
            role, _, lo, hi = next(Parser().feed(part))
            out.append((lo, hi) if role == loss_role else (0, 0))
        return pd.DataFrame(out, columns=["lo", "hi"])

    return formatted.withColumn("m", spans("rendered")).select("conv_id", "turn", "rendered", "m.lo", "m.hi")
