"""Chat formatting by a finite-state machine over roles.

A template is data: a marker that opens a turn of each role, one that closes
it, which roles are learned from, and which role may follow which. The machine
reads a conversation turn by turn, notes the first turn that is out of order,
and emits text segments with a loss flag each: marker, text, marker.

Texts are escaped so that no marker can arise inside one: the escape sign goes
before itself and before every sign that begins a marker. Undoing it is exact.

Turns are sorted within partitions by conversation, and a task streams through
them holding one Arrow batch, so even a very long conversation is never
gathered. Output is one row for each turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.shared import arrow_map


@dataclass(frozen=True)
class Template:
    """``opening`` needs ``{role}``; ``transitions`` maps a state (``start`` or the last role) to the roles that may come next."""

    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    escape: str = "\\"
    learned: frozenset[str] = frozenset({"assistant"})
    transitions: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        before, _, after = self.opening.partition("{role}")
        if len(self.escape) != 1 or not before or not after.strip() or not self.closing.strip():
            raise ValueError("a template needs an escape sign, a sign on either side of {role}, and a closing marker")
        if self.escape in before + after + self.closing:
            raise ValueError("markers may not hold the escape sign")

    @property
    def signs(self) -> str:
        """Signs that are escaped in texts and roles: the escape sign, the first of each marker, and the first that ends a role."""
        before, _, after = self.opening.partition("{role}")
        return "".join(dict.fromkeys([self.escape, before[0], after.lstrip()[0], self.closing.strip()[0]]))

    def escaped(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.signs)}])", lambda m: self.escape + m[1], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def render(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of one turn and whether each is learned."""
        before, _, after = self.opening.partition("{role}")
        return [(before + self.escaped(role) + after, False), (self.escaped(text), role in self.learned), (self.closing, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Turns of a formatted string. Raises ValueError where it isn't one."""
        before, _, after = self.opening.partition("{role}")
        body = rf"((?:[^{re.escape(self.signs)}]|{re.escape(self.escape)}.)*?)"
        turn = re.compile(re.escape(before) + body + re.escape(after) + body + re.escape(self.closing), re.DOTALL)
        at = 0
        while at < len(formatted):
            match = turn.match(formatted, at)
            if match is None:
                raise ValueError(f"no turn at {at}")
            yield self.unescaped(match[1]), self.unescaped(match[2])
            at = match.end()


class Machine:
    """Validates the order of roles; ``fault`` is the number of the first turn out of order, or of the end if it came too early."""

    def __init__(self, template: Template):
        self.template, self.state, self.turns, self.fault = template, "start", 0, None

    def step(self, role: str) -> None:
        if self.fault is None and role not in self.template.transitions.get(self.state, ()):
            self.fault = self.turns
        self.state = role
        self.turns += 1

    def end(self) -> int | None:
        return self.fault if self.fault is not None or self.state in self.template.final else self.turns


FORMATTED_SCHEMA = "conv_id long, turn_no long, segments array<struct<text: string, loss: boolean>>, in_order boolean"


def _by_conversation(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, turn_no, segments, in_order`` for every row of ``conversations(conv_id, turn, role, text)``.

    Turns are taken in the order of ``turn`` (nulls first), then role and text,
    and numbered from 0; repeated rows are all kept. Null roles and texts are
    empty. Rows whose ``conv_id`` is null form one conversation. ``in_order``
    is false from the first turn on that the template doesn't allow where it
    stands. Concatenating the segments' texts gives the formatted string. Other
    columns are ignored; an empty table gives no rows.
    """
    template = template or Template()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def render(batches):
        current, machine = object(), None
        for batch in batches:
            numbers, segments, fine = [], [], []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if conv != current:
                    current, machine = conv, Machine(template)
                numbers.append(machine.turns)
                machine.step(role)
                fine.append(machine.fault is None)
                segments.append([{"text": t, "loss": loss} for t, loss in template.render(role, text)])
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(segments, kind), pa.array(fine, pa.bool_())],
                ["conv_id", "turn_no", "segments", "in_order"],
            )

    return arrow_map(_by_conversation(rows, "turn", "role", "text"), render, FORMATTED_SCHEMA)


def formatted_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted turns back: one row for each conversation.

    ``conv_id, n_turns, turns_sha256`` (role, newline, text, newline of each
    turn), ``loss_chars, loss_sha256`` (unescaped text under the loss flag),
    ``formatted_chars, valid`` (order kept and last role allowed to be last).
    """
    template = template or Template()
    rows = formatted.select("conv_id", "turn_no", F.transform("segments", lambda s: s["text"]).alias("texts"), F.transform("segments", lambda s: s["loss"]).alias("flags"))

    def close(conv, state):
        machine, turns, chars, loss, size = state
        return conv, machine.turns, turns.hexdigest(), chars, loss.hexdigest(), size, machine.end() is None

    def read(batches):
        current, state = object(), None
        for batch in batches:
            out = []
            for conv, texts, flags in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        out.append(close(current, state))
                    current, state = conv, [Machine(template), hashlib.sha256(), 0, hashlib.sha256(), 0]
                joined = "".join(texts)
                for role, text in template.parse(joined):
                    state[0].step(role)
                    state[1].update(f"{role}\n{text}\n".encode())
                learned = template.unescaped("".join(t for t, flag in zip(texts, flags, strict=True) if flag))
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(joined)
            yield _digests(out)
        if state is not None:
            yield _digests([close(current, state)])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return arrow_map(_by_conversation(rows, "turn_no"), read, schema)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def digests_sql(rows: str, template: Template) -> str:
    """What ``formatted_digests`` returns for the conversations of the query ``rows``, in DuckDB's SQL."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    fixed = len(template.opening.replace("{role}", "")) + len(template.closing)
    escaped = " + ".join(f"length(said) - length(replace(said, {quoted(sign)}, ''))" for sign in template.signs)
    learned = ", ".join(map(quoted, sorted(template.learned)))
    allowed = " OR ".join(
        f"(coalesce(before, 'start') = {quoted(state)} AND role IN ({', '.join(map(quoted, sorted(roles)))}))" for state, roles in template.transitions.items()
    )
    final = ", ".join(map(quoted, sorted(template.final)))
    return f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
        coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role, '') || coalesce(text, '') AS said FROM ({rows})
),
placed AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role IN ({learned})), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role IN ({learned})), '')) AS loss_sha256,
    sum({fixed} + length(said) + {escaped})::BIGINT AS formatted_chars,
    bool_and({allowed}) AND arg_max(role, n) IN ({final}) AS valid
FROM placed GROUP BY conv_id"""
