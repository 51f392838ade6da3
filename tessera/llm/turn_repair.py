"""Conversation structure repair: cheapest edits by dynamic programming over a trie of role/fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources.workers import importable

from .common import hot_join, materialise

#: What edits cost: rerole, delete, insert, and leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Layers of a path in the trie that are kept for the signatures that follow; what lies deeper is computed for each signature.
SHARED = 4096
#: A turn's symbol: X must be deleted; the others are the role's class, in capitals if the turn is truncated.
MUST_DELETE = "X"
#: States of the roles so far: nothing, system, user, assistant. Where a role's class leads from each, and the role that a rerole or an insertion must have.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "o": (None, None, None, None)}
FORCED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}


class Edits:
    """The cheapest edits up to a place in a signature that leave the roles in one state: the last edit, and what came before."""

    __slots__ = ("before", "cost", "edit", "length")

    def __init__(self, before: Edits | None, cost: int, edit: str) -> None:
        self.before, self.cost, self.edit = before, cost, edit
        self.length = before.length + 1 if before else 0

    def __str__(self) -> str:
        out, at = [], self
        while at.before:
            out.append(at.edit)
            at = at.before
        return "".join(reversed(out))


def _less(x: Edits, y: Edits) -> bool:
    """Whether ``x`` costs less than ``y``, or as much with edits that are ASCII-least.

    Edits of the same text are the same object (they lead to one state of one layer), so the first difference is where two
    chains part, which is near as a rule. Of equal cost, neither can be the beginning of the other.
    """
    if x.cost != y.cost:
        return x.cost < y.cost
    if x is y:
        return False
    a, b = x, y
    while a.length > b.length:
        a = a.before
    while b.length > a.length:
        b = b.before
    if a is b:
        return x.length < y.length
    while a.before is not b.before:
        a, b = a.before, b.before
    return a.edit < b.edit


def _offer(layer: list[Edits | None], state: int, before: Edits, cost: int, edit: str) -> None:
    new = Edits(before, before.cost + cost, edit)
    if layer[state] is None or _less(new, layer[state]):
        layer[state] = new


def _insertions(layer: list[Edits | None]) -> list[Edits | None]:
    """Insertions at this place: a user turn from any state but its own, then an assistant turn. More of them come back to a state at a higher cost."""
    for state in (EMPTY, SYSTEM, ASSISTANT):
        if layer[state]:
            _offer(layer, USER, layer[state], INSERT, "I")
    if layer[USER]:
        _offer(layer, ASSISTANT, layer[USER], INSERT, "I")
    return layer


def first_layer() -> list[Edits | None]:
    return _insertions([Edits(None, 0, ""), None, None, None])


def next_layer(layer: list[Edits | None], symbol: str) -> list[Edits | None]:
    out: list[Edits | None] = [None] * 4
    left_in = TRUNCATED if symbol.isupper() else 0
    for state, edits in enumerate(layer):
        if edits is None:
            continue
        _offer(out, state, edits, DELETE, "D")
        if symbol != MUST_DELETE:
            if (kept := NEXT[symbol.lower()][state]) is not None:
                _offer(out, kept, edits, left_in, "K")
            _offer(out, FORCED[state], edits, REROLE + left_in, "R")
    return _insertions(out)


def answers(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of ``signatures`` in sorted order.

    They are put into a prefix trie one after the other. In sorted order only the path of the last one can be shared by what
    follows, so that path is all of the trie that is held, with the layer of each of its nodes; each layer is computed once for all
    signatures that share its prefix.
    """
    path, layers = "", [first_layer()]
    for signature in signatures:
        shared = 0
        most = min(len(path), len(signature), len(layers) - 1)
        while shared < most and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        layer = layers[shared]
        for symbol in signature[shared:]:
            layer = next_layer(layer, symbol)
            if len(layers) <= SHARED:
                layers.append(layer)
        path = signature
        best = layer[EMPTY]  # the roles may end as nothing or after an assistant
        if layer[ASSISTANT] and _less(layer[ASSISTANT], best):
            best = layer[ASSISTANT]
        yield signature, best.cost, str(best)


SPACE = r"\x20\x09-\x0D"


def marked(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None) -> DataFrame:
    """(conv, turn, role, text, h, here, initial, kind) of turns; h is a SHA-256 of role and text, kind is b(lank), t(runcated) or f(ine)."""
    out = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(True) if absent is None else ~F.coalesce(F.col(absent), F.lit(False))).alias("here"))
    kind = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "b").when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "t").otherwise("f")
    return out.select("conv", "turn", "role", "text", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("h"), "here", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"))


#: Order of a conversation's turns: by turn, nulls first; of one turn by role, then by hash, so that equal turns are neighbours.
ORDER = [F.asc_nulls_first, "conv"], [F.asc_nulls_first, "turn"], [F.asc, "role"], [F.asc, "h"]
LEGAL = {"su", "ua", "au"}


class Facts:
    """What is counted of one conversation while its turns go by: numbers, and a byte of signature a turn."""

    def __init__(self, conv) -> None:
        self.conv, self.signature = conv, bytearray()
        self.first = self.last = self.initial = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, kind: str, again: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        if kind == "b" or again:
            self.blank += kind == "b"
            self.duplicate += kind != "b"
            self.signature += MUST_DELETE.encode()
            return
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.truncated += kind == "t"
        self.signature += (symbol.upper() if kind == "t" else symbol).encode()

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, 2**63 - 1)
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.signature.decode()


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _batch(rows: list[tuple], conv: pa.DataType, **kinds: pa.DataType) -> pa.RecordBatch:
    types = {"conv": conv} | kinds
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def facts_of(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of each conversation in ``rows`` as ``marked`` gives them.

    Turns come without their texts, are dealt by conversation once, and go by in order; a batch may end inside a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = None, None
        kinds = dict(gaps=pa.int64(), blank=pa.int64(), duplicate=pa.int64(), truncated=pa.int64(), illegal=pa.int64(), signature=pa.string())
        for batch in batches:
            kind, done = batch.schema.field("conv").type, []
            for conv, turn, initial, what, here, again in _columns(batch, "conv", "turn", "initial", "kind", "here", "again"):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.row())
                    held = Facts(conv)
                if here:
                    held.add(turn, initial, what, again)
            if done:
                yield _batch(done, kind, **kinds)
        if held is not None:
            yield _batch([held.row()], kind, **kinds)

    narrow = rows.select("conv", "turn", "role", "h", "here", "initial", "kind").repartition("conv")
    first = W.partitionBy("conv", "h", "here").orderBy(F.asc_nulls_first("turn"))  # the shuffle above serves this too
    inside = narrow.withColumn("again", F.row_number().over(first) > 1).sortWithinPartitions(*[f(c) for f, c in ORDER], "again")
    return inside.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {FACTS}")


def answers_of(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) for distinct ``signatures``, dealt in ranges so that those with a common prefix meet in one trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chars = [], 0  # the trie's path goes on from batch to batch
        for row in answers(s for batch in batches for s in batch.column("signature").to_pylist()):
            found.append(row)
            chars += len(row[0])
            if len(found) == 4096 or chars > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["signature", "cost", "audit"])
                found, chars = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["signature", "cost", "audit"])

    return signatures.select("signature").repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


class Editor:
    """Applies an audit to the turns that go by: gives (edit, role, text) of each turn of the repaired conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, EMPTY

    def _insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = FORCED[self.state]
            yield "I", ROLES[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[role[:1]][self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = FORCED[self.state]
            yield edit, ROLES[self.state], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._insertions()
        if self.at != len(self.audit):
            raise ValueError("the audit belongs to other turns")


def _in_order(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The turns of ``rows``, each conversation's behind a row with what ``judged`` has of it; dealt by conversation."""
    facts = [c for c in judged.columns if c != "conv"]
    kinds = judged.select(F.struct(*facts).alias("x")).schema["x"].dataType
    heads = judged.select("conv", F.lit(0).alias("part"), F.struct(*facts).alias("facts"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "h")])
    turns = rows.where("here").select("conv", F.lit(1).alias("part"), F.lit(None).cast(kinds).alias("facts"), "turn", "role", "text", "h")
    (conv, *rest) = [f(c) for f, c in ORDER]
    return heads.union(turns).repartition("conv").sortWithinPartitions(conv, "part", *rest)


def judge(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature, cost, audit) of each conversation in ``rows`` as ``marked`` gives them, written down."""
    facts = materialise(facts_of(rows), "turn-facts")
    counted = materialise(facts.groupBy("signature").agg(F.count("*").alias("times")), "turn-signatures")
    found = materialise(answers_of(counted), "turn-answers")
    total = counted.agg(F.sum("times")).first()[0] or 0
    return materialise(hot_join(facts, counted.join(found, "signature"), ["signature"], "times", total).drop("times"), "turn-judged")


def repair(turns: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) for conversations of (conv_id, turn, role, text), whose names may be given as conv, turn, role and text.

    report: conv, gaps, blank, duplicate, truncated, illegal, signature, cost, audit. repaired: conv, at (from 0), turn (null if inserted),
    role, text, edit (K, R or I). The cheapest edits give roles whose initials are ``(s?(ua)+)?``; of equally cheap ones the ASCII-least count.
    Null roles and texts count as one space, null conversations as one conversation, null turns come first; turns of one number go by role, then by hash. A column named
    by ``absent`` marks turns that aren't there: a conversation of only such turns is reported, with nothing in it.

    A conversation goes through one task turn by turn, in order, with its texts a batch at a time: what is held of it is a byte of signature and
    of audit a turn, so its length is bounded by what a string column may hold. Repeated rows are duplicates. Very long texts are hashed and checked in the JVM and go through
    whole. Signatures are counted before they are shuffled, and hot ones go back by broadcast. An empty table gives empty tables; other columns are left out.
    """
    importable(turns.sparkSession)
    rows = marked(turns, **names)
    judged = judge(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, held, at, kind = None, None, 0, None
        kinds = dict(at=pa.int64(), turn=pa.int64(), role=pa.string(), text=pa.string(), edit=pa.string())
        for batch in batches:
            kind, out = batch.schema.field("conv").type, []
            for conv, part, facts, turn, role, text in _columns(batch, "conv", "part", "facts", "turn", "role", "text"):
                for edit, new_role, new_text in (editor.turn(role, text) if part else editor.end() if editor else ()):
                    out.append((held, at, None if edit == "I" else turn, new_role, new_text, edit))
                    at += 1
                if not part:
                    editor, held, at = Editor(facts["audit"]), conv, 0
            if out:
                yield _batch(out, kind, **kinds)
        if editor and (out := [(held, at + k, None, role, text, edit) for k, (edit, role, text) in enumerate(editor.end())]):
            yield _batch(out, kind, **kinds)

    with_text = _in_order(rows, judged.select("conv", "audit"))
    return judged, with_text.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, at long, turn long, role string, text string, edit string")


def repaired_digests(turns: DataFrame, **names: str) -> DataFrame:
    """The report of ``repair`` with repaired_sha256: of the repaired turns as ``role:text``, joined by line feeds. Made in one pass over the turns."""
    importable(turns.sparkSession)
    rows = marked(turns, **names)
    judged = judge(rows)
    facts = [c for c in judged.columns if c != "conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, head, digest, empty = None, None, None, True

        def take(edited: Iterable[tuple[str, str, str]]) -> None:
            nonlocal empty
            for _, role, text in edited:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        def closed() -> tuple:
            take(editor.end())
            return *head, digest.hexdigest()

        kinds = {c: pa.string() if c in ("signature", "audit") else pa.int64() for c in facts} | {"repaired_sha256": pa.string()}
        kind = None
        for batch in batches:
            kind, done = batch.schema.field("conv").type, []
            for conv, part, known, role, text in _columns(batch, "conv", "part", "facts", "role", "text"):
                if part:
                    take(editor.turn(role, text))
                else:
                    if editor:
                        done.append(closed())
                    editor, head, digest, empty = Editor(known["audit"]), (conv, *(known[c] for c in facts)), hashlib.sha256(), True
            if done:
                yield _batch(done, kind, **kinds)
        if editor:
            yield _batch([closed()], kind, **kinds)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in judged.schema.fields)
    return _in_order(rows, judged).mapInArrow(run, f"{schema}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with made faults, by a checksum of conversation and turn: of 20, one marks the turn absent, one empties its text, one takes its sentence ends, one
    repeats it, one makes it the user's. Nulls count as one space, here as in the result."""
    one = F.lit(" ")
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), (k == 0).alias("absent"), copies.alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired_digests(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent="absent")
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _plus(value: str, cost: str, edit: str) -> str:
    """SQL of a value with one more edit. A value is the cost in twelve digits, then the audit, so that the least string is the cheapest, ASCII-least one."""
    return f"lpad(CAST(CAST(substr({value}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({value}, 13) || '{edit}'"


def _kept(value: str, roles: str) -> str:
    return f"CASE WHEN x <> 'X' AND lower(x) = '{roles}' THEN {_plus(value, 'late', 'K')} END"


def _reroled(value: str) -> str:
    return f"CASE WHEN x <> 'X' THEN {_plus(value, '1 + late', 'R')} END"


_SPACES = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))
_USER, _ASSISTANT = f"least(u0, {_plus('e0', '5', 'I')}, {_plus('s0', '5', 'I')}, {_plus('a0', '5', 'I')})", f"least(a0, {_plus('u', '5', 'I')})"

#: crc32 from its table; the edits as a recursion over the turns with the cheapest edits for each state: nothing, system, user, assistant.
OP12_SQL = f"""
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
hexed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k FROM hexed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE k <> 0),
told AS (SELECT *, left(role, 1) AS initial, rtrim(text, {_SPACES}) AS short, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM told),
faulty AS (SELECT *, short = '' AS blank, short <> '' AND seen > 1 AS duplicate, short <> '' AND seen = 1 AND right(short, 1) NOT IN ('.', '!', '?') AS truncated, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM again),
signed AS (SELECT *, CASE WHEN blank OR duplicate THEN 'X' WHEN initial IN ('s', 'u', 'a') THEN CASE WHEN truncated THEN upper(initial) ELSE initial END ELSE CASE WHEN truncated THEN 'O' ELSE 'o' END END AS x, CASE WHEN truncated THEN 5 ELSE 0 END AS late FROM faulty),
walk(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000000', CAST(NULL AS VARCHAR), '000000000005I', '000000000010II' FROM conversations
  UNION ALL
  SELECT conv_id, i, e0, s0, u, {_ASSISTANT} FROM (SELECT conv_id, i, e0, s0, a0, {_USER} AS u FROM (
    SELECT w.conv_id, d.i, {_plus("e", "2", "D")} AS e0, least({_plus("s", "2", "D")}, {_kept("e", "s")}) AS s0,
     least({_plus("u", "2", "D")}, {_kept("e", "u")}, {_kept("s", "u")}, {_kept("a", "u")}, {_reroled("e")}, {_reroled("s")}, {_reroled("a")}) AS u0,
     least({_plus("a", "2", "D")}, {_kept("u", "a")}, {_reroled("u")}) AS a0
    FROM walk w JOIN signed d ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = w.i + 1))),
ended AS (SELECT conv_id, arg_max(least(e, a), i) AS best FROM walk GROUP BY conv_id),
judged AS (SELECT conv_id, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM ended),
steps AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM judged WHERE audit <> ''),
edits AS (SELECT conv_id, p, substr(audit, CAST(p AS INTEGER), 1) AS edit, p - length(replace(substr(audit, 1, CAST(p AS INTEGER)), 'I', '')) AS added FROM steps),
left_in AS (SELECT e.conv_id, e.p, e.edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role, initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS q FROM edits e LEFT JOIN signed d ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND e.edit <> 'I' AND d.i = e.p - e.added WHERE edit <> 'D'),
led AS (SELECT *, max(CASE WHEN q = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM left_in),
mended AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (q - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY q) AS said FROM led GROUP BY conv_id),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM signed GROUP BY conv_id)
SELECT j.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM judged j LEFT JOIN counts c ON j.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON j.conv_id IS NOT DISTINCT FROM m.conv_id
"""
