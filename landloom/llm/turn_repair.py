"""Repair of conversation structure by a shortest path with scalar weights.

A conversation should read ``(system)? (user assistant)+`` or be empty. Rows may be blank,
repeated, cut off, out of role or missing; edits (keep, rerole, delete, insert)
have costs, and the cheapest edits whose roles read well are taken, of equally
cheap ones those whose initials (``D I K R``) come first as a string, the audit.

A path through (row, state of the role grammar) has one integer as its weight: its high
digits are the cost, its low digits, of fixed width, the letters of the audit by position, with
zeros after the last. So plain ``min`` over integers settles cost and ties at once. Two paths
that have read the same rows at the same cost are never a prefix of one another (what is longer
would have inserted more), so the lesser one stays the lesser whatever follows. For the same reason a
long conversation is worked off in segments of ``SEGMENT`` rows: after a segment the
letters so far give way to one digit, the rank of the path among the (at most four) paths left. Work is linear in the rows.

Scale. Damage, repeats and marks are DataFrame steps: equal rows of a conversation are
first counted, then one minimum per (conversation, role, text) tells the first of
its kind, so a conversation or a phrase that a third of all rows share is no hot group there. The audit
and the digest of a conversation are values of its whole sequence: rows are dealt
by conversation, sorted, and streamed; a task holds one byte a row of the
conversation in hand for the audit, and one row for the digest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import WHITE, discard, saved, text_bytes
from landloom.session import spread

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, ASKED, ANSWERED = range(4)
BITS = 3
SEGMENT = 256
#: One byte a row: 3 * role initial (s, u, a, other) + (sound, cut off, must go).
ROLES = "sua"
SOUND, CUT, GONE = range(3)


def row_code(initial: str, fault: int) -> int:
    return 3 * (ROLES.index(initial) if initial and initial in ROLES else 3) + fault


class _Weights:
    """Integer weights for a segment of ``rows`` rows: cost, rank of what came before, letters."""

    def __init__(self, rows: int):
        self.width = 3 * rows + 2
        self.unit = 1 << (BITS * (self.width + 1))

    def start(self, cost: int, rank: int) -> int:
        return cost * self.unit + (rank << (BITS * self.width))

    def then(self, weight: int, letter: int, more: int = 0) -> int:
        """The weight after one more letter, in the first place that is zero."""
        digits = weight & ((1 << (BITS * self.width)) - 1)
        free = self.width - 1 if not digits else ((digits & -digits).bit_length() - 1) // BITS - 1
        return weight + (COST[letter] + more) * self.unit + (letter << (BITS * free))

    def parts(self, weight: int) -> tuple[int, int, str]:
        """Cost, rank and letters."""
        cost, rest = divmod(weight, self.unit)
        rank, digits = divmod(rest, 1 << (BITS * self.width))
        said = []
        for place in range(self.width - 1, -1, -1):
            letter = digits >> (BITS * place) & 7
            if not letter:
                break
            said.append(LETTERS[letter])
        return cost, rank, "".join(said)


def _with_inserts(w: _Weights, at: dict[int, int]) -> dict[int, int]:
    """Paths with up to two rows inserted in the gap before a row or at the end.

    A user row first, then an assistant row; a third would only return to where the first led.
    """
    at = dict(at)
    for goal, sources in ((ASKED, (START, SYSTEM, ANSWERED)), (ANSWERED, (ASKED,))):
        found = [w.then(at[s], INSERT) for s in sources if s in at]
        if found:
            at[goal] = min([*found, *([at[goal]] if goal in at else [])])
    return at


def _over_row(w: _Weights, at: dict[int, int], code: int) -> dict[int, int]:
    role, fault = divmod(code, 3)
    after: dict[int, int] = {}

    def reach(state: int, weight: int) -> None:
        after[state] = min(weight, after.get(state, weight))

    for state, weight in at.items():
        reach(state, w.then(weight, DELETE))
        if fault == GONE:
            continue
        more = int(fault == CUT)
        goal = ANSWERED if state == ASKED else ASKED
        reach(goal, w.then(weight, REROLE, more))
        if role == 0 and state == START:
            reach(SYSTEM, w.then(weight, KEEP, more))
        elif (role == 1 and goal == ASKED) or (role == 2 and goal == ANSWERED):
            reach(goal, w.then(weight, KEEP, more))
    return after


def cheapest_edits(codes: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation given as one ``row_code`` a row."""
    w = _Weights(min(segment, len(codes)))
    at, history = {START: w.start(0, 0)}, []
    for begin in range(0, len(codes), segment):
        if begin:
            told = {state: w.parts(weight) for state, weight in at.items()}
            order = sorted(told, key=lambda s: (told[s][1], told[s][2]))
            history.append([(told[s][1], told[s][2]) for s in order])
            w = _Weights(min(segment, len(codes) - begin))
            at = {s: w.start(told[s][0], rank) for rank, s in enumerate(order)}
        for code in codes[begin : begin + segment]:
            at = _over_row(w, _with_inserts(w, at), code)
    at = _with_inserts(w, at)
    cost, rank, letters = w.parts(min(at[s] for s in (START, ANSWERED) if s in at))
    said = [letters]
    for paths in reversed(history):
        rank, letters = paths[rank]
        said.append(letters)
    return cost, "".join(reversed(said))


@functools.lru_cache(1 << 16)
def _known_edits(codes: bytes) -> tuple[int, str]:
    return cheapest_edits(codes)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one row in twenty dropped, emptied, stripped of its ``.!?``, repeated, made a user's.

    CRC-32 of ``conv_id:turn`` decides. Nulls are one space in it, in roles and in texts.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_1") == 1, "").when(F.col("_1") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("_1") == 4, "user").otherwise(said("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_1") == 3, 2).otherwise(1)))
    own = rows.select("conv_id", "turn", "role", "text", fate.alias("_1")).where("_1 <> 0")
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_2")).drop("_2")


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows ``conv_id, turn, role, text`` with ``copies``, ``fault`` and ``more`` (saved).

    ``fault`` is the first copy's: blank, duplicate, truncated or empty; ``more`` that of its repeats (blank or duplicate).
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    whole = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"))
    whole = whole.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    kind = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.octet_length("role"), "role", "text"), 256)
    whole = saved(whole.withColumns({"kind": F.unhex(kind), "tie": F.md5("text")}), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("n"), F.coalesce("turn", F.lit(0)).alias("t"))
    firsts = whole.groupBy("kind").agg(F.min(when).alias("first"))
    blank = F.translate("text", WHITE, "") == ""
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(when != F.col("first"), "duplicate").when(cut, "truncated").otherwise("")
    met = whole.join(firsts, "kind")
    out = met.select("conv_id", "turn", "role", "text", "tie", "copies", fault.alias("fault"), F.when(blank, "blank").otherwise("duplicate").alias("more"))
    out = saved(out, "marked")
    discard(whole)
    return out


ORDER = ("turn", "role", "tie")


def _sequence(*, lead: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), *[F.col(c) for c in lead], *[F.col(c).asc_nulls_first() for c in ORDER]]


REPORT = [(c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
NONE = object()


def reports(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id``, counts of faults, cost and audit per conversation of ``convs`` from ``marked`` rows (saved)."""
    names = ["conv_id", *[c for c, _ in REPORT], "audit"]
    kinds = [pa.int64(), *[pa.int64()] * len(REPORT), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, done = NONE, []

        def close() -> None:
            if conv is not NONE:
                own = bytes(codes)
                cost, audit = _known_edits(own) if len(own) <= 32 else cheapest_edits(own)
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
                done.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit))

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "copies", "fault", "more"))):
                if row[0] != conv:
                    close()
                    conv, codes, before, turns = row[0], bytearray(), None, None
                    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "": 0}
                _, turn, initial, copies, fault, more = row
                if not copies:
                    continue
                if turn is not None:
                    turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
                counts[fault] += 1
                counts[more] += copies - 1
                counts["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
                counts["illegal"] += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
                before = initial
                codes.append(row_code(initial, {"": SOUND, "truncated": CUT}.get(fault, GONE)))
                codes += bytes([row_code(initial, GONE)]) * (copies - 1)
            if done:
                yield batch_of(done)
                done.clear()
        close()
        if done:
            yield batch_of(done)

    own = rows.select("conv_id", "turn", "role", "tie", F.substring("role", 1, 1).alias("initial"), "copies", "fault", "more")
    empty = {"turn": "long", "role": "string", "tie": "string", "initial": "string"}
    lone = convs.select(F.col("conv_id").cast("long")).distinct()
    lone = lone.select("conv_id", *[F.lit(None).cast(k).alias(c) for c, k in empty.items()], F.lit(0).cast("long").alias("copies"), F.lit("").alias("fault"), F.lit("").alias("more"))
    dealt = spread(own.unionByName(lone), "conv_id").sortWithinPartitions(*_sequence())
    return saved(dealt.mapInArrow(run, ", ".join(["conv_id long", *[f"{c} {k}" for c, k in REPORT], "audit string"])), "reports")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, edit, role, text)`` of every edit, from rows sorted by conversation, each led by its audit.

    Deletions have no role. A conversation opens with an edit of empty letter.
    """
    conv, audit, at, state = NONE, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at += 1
            state = ANSWERED if state == ASKED else ASKED
            yield conv, "I", "user" if state == ASKED else "assistant", b""

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "copies")]
        for own, said, role, copies, text in zip(*columns, text_bytes(batch.column("text"))):
            if said is not None:
                if conv is not NONE:
                    yield from inserted()
                conv, audit, at, state = own, said, 0, START
                yield conv, "", None, b""
                continue
            for _ in range(copies):
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    yield conv, edit, None, text
                    continue
                if edit == "K" and state == START and role[:1] == "s":
                    state, new = SYSTEM, role
                else:
                    state = ANSWERED if state == ASKED else ASKED
                    new = role if edit == "K" else "user" if state == ASKED else "assistant"
                yield conv, edit, new, text
    if conv is not NONE:
        yield from inserted()


def _led(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, each led by a row with its audit."""
    own = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "tie", "text", "copies", F.lit(None).cast("string").alias("audit"))
    none = lambda k: F.lit(None).cast(k)  # noqa: E731
    lead = report.select(
        "conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("tie"),
        none("string").alias("text"), none("long").alias("copies"), "audit",
    )  # fmt: skip
    return spread(own.unionByName(lead), "conv_id").sortWithinPartitions(*_sequence(lead=("part",)))


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of the repaired conversations, ``place`` from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, place = ["conv_id", "place", "edit", "role", "text"], [], 0
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for conv, edit, role, text in _edited(batches):
            if not edit:
                place = 0
            elif role is not None:
                held.append((conv, place, edit, role, text.decode("utf-8", "replace")))
                place += 1
            if len(held) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return _led(rows, report).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of the repaired rows as ``role:text``, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, conv, first = [], None, None, True

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], ["conv_id", "repaired_sha256"])

        for own, edit, role, text in _edited(batches):
            if not edit:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, first = own, hashlib.sha256(), True
                if len(done) >= 4096:
                    yield batch_of(done)
                    done = []
            elif role is not None:
                digest.update((b"" if first else b"\n") + role.encode() + b":" + text)
                first = False
        if digest is not None:
            done.append((conv, digest.hexdigest()))
            yield batch_of(done)

    return _led(rows, report).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, convs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports of the conversations (of ``convs``, where given) and their marked rows, for ``repaired_rows`` or ``repaired_digests``.

    Rows are taken by turn, null turns first; rows of one turn by role, then by digest of
    their text; equal rows are copies of one another, the later ones duplicates. Null roles and
    texts are one space, so such a text is blank; a null ``conv_id`` is a conversation of its own. Very long texts only pass
    through; a conversation without rows has zeros and an empty audit; an empty table gives
    nothing; other columns, whatever their names, are ignored.
    """
    found = marked(rows)
    return reports(found, rows if convs is None else convs), found


def repair_summary(conversations: DataFrame) -> DataFrame:
    """What the damaged ``conversations`` lack, what their repair costs, its audit and its digest: one row per ``conv_id``."""
    report, found = repair(damaged(conversations), conversations)
    digests = repaired_digests(found, report).select(F.col("conv_id").alias("_of"), "repaired_sha256")
    met = report.join(digests, report["conv_id"].eqNullSafe(digests["_of"]))
    return met.select("conv_id", *[c for c, _ in REPORT], "audit", "repaired_sha256")


CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii({key}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, len({key}) + 1)])),
  LAMBDA c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""

ORACLE = (
    r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fated AS (SELECT *, """
    + CRC.format(key="k")
    + r""" % 20 AS f FROM keyed),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS c
  FROM fated WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), c) AS i FROM rows_
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), steps AS (
  -- Rows as (initial, must it go, is it cut off); one step past the last row closes the last gap.
  SELECT conv_id, i, role, text, role[1] AS r, fault IN ('blank', 'duplicate') AS go, (fault = 'truncated')::INT AS cut FROM judged
  UNION ALL SELECT conv_id, n + 1, NULL, NULL, NULL, NULL, 0 FROM counted
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 'o': ''} AS s0, {'c': 1000000000, 'a': '', 'o': ''} AS s1,
         {'c': 1000000000, 'a': '', 'o': ''} AS s2, {'c': 1000000000, 'a': '', 'o': ''} AS s3 FROM counted
  UNION ALL
  SELECT conv_id, i,
    CASE WHEN go IS NULL THEN s0 ELSE {'c': s0.c + 3, 'a': s0.a || 'D', 'o': s0.o} END,
    CASE WHEN go IS NULL THEN s1 ELSE least({'c': s1.c + 3, 'a': s1.a || 'D', 'o': s1.o},
      {'c': s0.c + CASE WHEN go OR r <> 's' THEN 1000000000 ELSE cut END, 'a': s0.a || 'K', 'o': role || ':' || text}) END,
    CASE WHEN go IS NULL THEN m2 ELSE least({'c': m2.c + 3, 'a': m2.a || 'D', 'o': m2.o},
      {'c': s0.c + ask, 'a': s0.a || letter_u, 'o': said_u}, {'c': s1.c + ask, 'a': s1.a || letter_u, 'o': s1.o || chr(10) || said_u},
      {'c': m3.c + ask, 'a': m3.a || letter_u, 'o': m3.o || chr(10) || said_u}) END,
    CASE WHEN go IS NULL THEN m3 ELSE least({'c': m3.c + 3, 'a': m3.a || 'D', 'o': m3.o}, {'c': m2.c + answer, 'a': m2.a || letter_a, 'o': m2.o || chr(10) || said_a}) END
  FROM (
    SELECT *, least(s3, {'c': m2.c + 2, 'a': m2.a || 'I', 'o': m2.o || chr(10) || 'assistant:'}) AS m3,
      CASE WHEN go THEN 1000000000 WHEN r = 'u' THEN cut ELSE cut + 2 END AS ask, CASE WHEN go THEN 1000000000 WHEN r = 'a' THEN cut ELSE cut + 2 END AS answer,
      CASE WHEN r = 'u' THEN 'K' ELSE 'R' END AS letter_u, CASE WHEN r = 'a' THEN 'K' ELSE 'R' END AS letter_a,
      CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text AS said_u, CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text AS said_a
    FROM (
      SELECT dp.conv_id, st.i, s0, s1, s3, role, text, r, go, cut,
        least(s2, {'c': s0.c + 2, 'a': s0.a || 'I', 'o': 'user:'}, {'c': s1.c + 2, 'a': s1.a || 'I', 'o': s1.o || chr(10) || 'user:'},
              {'c': s3.c + 2, 'a': s3.a || 'I', 'o': s3.o || chr(10) || 'user:'}) AS m2
      FROM dp JOIN steps st ON dp.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = dp.i + 1
    )
  )
), ended AS (SELECT dp.conv_id, least(s0, s3) AS best FROM dp JOIN counted c ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n + 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
)
