"""Chat formatting with a grammar that reads back.

A conversation is the concatenation of its turns:

    turn = "### " role ":\\n" body "\\n</turn>\\n"

Inside a body the control strings ``### `` and ``</turn>`` stand for themselves
only behind an odd run of backslashes: n backslashes and a control string are
written as 2n+1 of them. Each turn is first rendered as it is, parsed again and
compared; where the turn that comes back differs, its text is escaped and the
comparison made again. The loss mask covers the bodies of assistant turns.

Scale. Rendering and checking a turn needs the turn alone. Conversations are put
in order by one shuffle on their id and a sort inside the partitions, and read
as a stream: a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"(\\*)(### |</turn>)")
HEAD = re.compile(r"### ([^\n]*):\n")
FOOT = "\n</turn>\n"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in NAMES.items()}


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\1\\\2", text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2] if len(m[1]) % 2 else m[0], text)


def role_name(role: str) -> str:
    """Known roles by name, any other behind ``~`` with its odd characters as %XX."""
    return NAMES.get(role) or "~" + quote(role, safe="")


class TurnReader:
    """The parser: takes text bit by bit, gives ``(role, body start, body end, text)`` of whole turns.

    Positions count characters from the start of the conversation.
    """

    def __init__(self):
        self.rest, self.at = "", 0

    def feed(self, more: str) -> Iterator[tuple[str, int, int, str]]:
        self.rest += more
        while (head := HEAD.match(self.rest)) is not None:
            end = self.rest.find(FOOT, head.end())
            if end < 0:
                return
            body, name = self.rest[head.end() : end], head[1]
            if any(len(m[1]) % 2 == 0 for m in CONTROL.finditer(body)):
                raise ValueError("a control string inside a body")
            if name not in ROLES and not name.startswith("~"):
                raise ValueError(f"unknown role {name!r}")
            role = ROLES[name] if name in ROLES else unquote(name[1:])
            yield role, self.at + head.end(), self.at + end, unescaped(body)
            self.at += end + len(FOOT)
            self.rest = self.rest[end + len(FOOT) :]

    def close(self) -> None:
        if self.rest:
            raise ValueError("text after the last whole turn")


def _reads_back(rendered: str, role: str, text: str) -> bool:
    reader = TurnReader()
    try:
        turns = list(reader.feed(rendered))
        reader.close()
    except ValueError:
        return False
    return [(t[0], t[3]) for t in turns] == [(role, text)]


def render(role: str, text: str) -> str:
    """The turn as formatted text; escaped only where it would not read back."""
    head = f"### {role_name(role)}:\n"
    plain = head + text + FOOT
    if _reads_back(plain, role, text):
        return plain
    safe = head + escaped(text) + FOOT
    if not _reads_back(safe, role, text):
        raise ValueError("an escaped turn does not read back")
    return safe


TURNS = "conv_id long, turn long, role string, text string, rendered string, loss_from int, loss_to int"


def format_turns(conversations: DataFrame) -> DataFrame:
    """Each turn with its ``rendered`` form and the loss span inside it (null: none).

    Null texts and null roles count as empty; repeated rows are turns of their
    own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, low, high = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                out = render(role, text)
                made.append(out)
                loss = role == "assistant"
                low.append(out.index("\n") + 1 if loss else None)
                high.append(len(out) - len(FOOT) if loss else None)
            own = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(made, pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["conv_id", "turn", "role", "text", "rendered", "loss_from", "loss_to"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return rows.mapInArrow(run, TURNS)


def _in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order of turn (null last), role and text."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: whole texts and their loss mask (character spans).

    One row per conversation; use ``read_back`` on ``format_turns`` where a single
    conversation may not fit in memory.
    """
    turns = format_turns(conversations)
    part = F.struct(F.col("turn").isNull().alias("n"), "turn", "role", "text", "rendered", "loss_from", "loss_to")
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    ends = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["rendered"])).alias("at"),
            F.when(t["loss_from"].isNull(), a["spans"])
            .otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + t["loss_from"]).alias("start"), (a["at"] + t["loss_to"]).alias("end")))))
            .alias("spans"),
        ),
    )
    text = F.array_join(F.transform("p", lambda t: t["rendered"]), "")
    return gathered.select("conv_id", text.alias("formatted"), ends["spans"].alias("loss_spans"))


BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Summary:
    def __init__(self):
        self.reader, self.turns, self.loss = TurnReader(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.spans: list[tuple[int, int]] = []

    def feed(self, rendered: str, low: int | None, high: int | None) -> None:
        if low is not None:
            self.spans.append((self.chars + low, self.chars + high))
        self.chars += len(rendered)
        for role, start, end, text in self.reader.feed(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if self.spans and self.spans[0] == (start, end):
                self.spans.pop(0)
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self) -> tuple:
        self.reader.close()
        if self.spans:
            raise ValueError("the loss mask does not cover whole bodies")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame) -> DataFrame:
    """Parse the formatted turns again and describe each conversation by what was read.

    ``turns_sha256`` is over role, newline, text, newline per turn; ``loss_*`` over
    the unescaped text under the mask; ``formatted_chars`` counts the formatted text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, summary, out = None, None, []

        def batch_of(rows):
            names = [f.split()[0] for f in BACK.split(", ")]
            kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_from", "loss_to")]
            for conv, rendered, low, high in zip(*columns):
                if summary is None or conv != current:
                    if summary is not None:
                        out.append((current, *summary.row()))
                    current, summary = conv, _Summary()
                summary.feed(rendered, low, high)
            if len(out) > 2000:
                yield batch_of(out)
                out = []
        if summary is not None:
            out.append((current, *summary.row()))
        if out:
            yield batch_of(out)

    return _in_order(turns).select("conv_id", "rendered", "loss_from", "loss_to").mapInArrow(run, BACK)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), r AS (
  SELECT *, length('### ' || upper(role[1:1]) || role[2:] || chr(58) || chr(10)) + length(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g')) + 9 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
