"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the strings before and after a turn's text and whether the
text is learned from; its transitions say which role may follow which. Every turn becomes
segments (text, loss) in order; markers never carry loss. Inside texts the first characters of
markers and the escape sign are written as two-character escapes, so no text can hold a marker
and the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T


@dataclass(frozen=True)
class Template:
    """before, after: strings around a role's text; any other role uses `other`, with its name in place of {}."""

    before: dict[str, str] = field(default_factory=lambda: {"system": "[SYS] ", "user": "[INST] ", "assistant": "<s>"})
    after: dict[str, str] = field(default_factory=lambda: {"system": " [/SYS]\n", "user": " [/INST]", "assistant": "</s>\n"})
    other: tuple[str, str] = ("[ROLE {}] ", " [/ROLE]\n")
    loss: frozenset[str] = frozenset({"assistant"})
    follows: frozenset[tuple[str, str]] = frozenset({("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))

    def escape(self, text: str) -> str:
        return text.translate({ord(a): b for a, b in self.escapes})

    def unescape(self, text: str) -> str:
        back = {b[1]: a for a, b in self.escapes}
        return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S)

    def around(self, role: str) -> tuple[str, str]:
        if role in self.before:
            return self.before[role], self.after[role]
        return self.other[0].format(self.escape(role)), self.other[1]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        before, after = self.around(role)
        return [(before, False), (self.escape(text), role in self.loss), (after, False)]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, before in self.before.items():
            if turn.startswith(before):
                return role, self.unescape(turn[len(before) : len(turn) - len(self.after[role])])
        head, tail = self.other[0].split("{}")
        name, _, rest = turn[len(head) :].partition(tail)
        return self.unescape(name), self.unescape(rest[: len(rest) - len(self.other[1])])


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("valid", pa.bool_()), ("segments", _SEGMENTS)])
FORMATTED = "conv_id long, position long, valid boolean, segments array<struct<text: string, loss: boolean>>"


def _format(template: Template):
    def run(batches):
        conv, state, position, valid = object(), "", 0, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state, position, valid = row["conv_id"], "", 0, True
                valid = valid and (state, row["role"]) in template.follows
                state = row["role"]
                out.append({"conv_id": conv, "position": position, "valid": valid, "segments": [{"text": t, "loss": m} for t, m in template.segments(row["role"], row["text"])]})
                position += 1
            yield pa.RecordBatch.from_pylist(out, schema=_FORMATTED)

    return run


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each turn: conv_id, position (from 0), valid and segments (text, loss).

    valid is whether the machine has accepted the conversation's roles up to this turn; refused
    conversations are formatted all the same. Turns are in the order of turn, then role and text,
    nulls first. A null text or role counts as empty; rows whose conv_id is null are one
    conversation. A conversation is streamed, never held: partitions are dealt by conv_id and
    sorted, and stay so in the result.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(T.tidied(_format(template or Template())), FORMATTED)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _digest(template: Template):
    def run(batches):
        out: list[dict] = []
        row = None

        def close():
            if row is not None:
                out.append({**row, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

        for batch in batches:
            for turn in batch.to_pylist():
                if turn["position"] == 0:
                    close()
                    row = {"conv_id": turn["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "valid": True}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                formatted = "".join(s["text"] for s in turn["segments"])
                learned = template.unescape("".join(s["text"] for s in turn["segments"] if s["loss"]))
                role, text = template.parse(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                row["n_turns"] += 1
                row["loss_chars"] += len(learned)
                row["formatted_chars"] += len(formatted)
                row["valid"] = turn["valid"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)

    return run


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, parsed from the rows of `format_chat` in the order that it leaves them."""
    return formatted.mapInArrow(T.tidied(_digest(template or Template())), DIGEST)
