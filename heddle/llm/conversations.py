"""Repairing the order of speakers in conversations at the least cost.

A repaired conversation is empty, or alternates user and assistant turns, ends with
the assistant and may begin with a system turn.  Each row is kept (0), given the
user's or assistant's role (3) or deleted (4, needed for blank and repeated rows);
empty turns may be inserted (3); a truncated row that stays costs 3 more.  The graph
of (rows done, last speaker) has small integer costs, so Dial's queue of buckets gives
every node's distance to the end; a walk along tight arcs, least letter first, is
the audit.

A conversation may hold any share of the rows.  Rows are sorted by range, which splits
a large conversation, and numbered; faults are found by aggregates over
(conversation, digest of role and text).  Then a row is one letter, and a
conversation's letters are gathered in segments of at most 4,096 and then in one cell:
as long as its audit, which is one cell too.  Texts are never gathered: they stream in
order past the audit into the digest.  SHA-256 takes its input in sequence, so one task
reads the texts of one conversation.

Null roles and texts are one space; null turns come first; rows of one turn come in the
order of a digest of their role and text as given, so repeated rows lie side by side
and all but one of them are duplicates; a null conv_id is a conversation; an empty table
gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lanes, mapped, settle

SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # the last speaker
NEXT = (USER, USER, ASSISTANT, USER)  # who may speak where a turn is free
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
OK, BLANK, DUPLICATE, CUT = range(4)  # faults
SEGMENT_BITS = 12


def damaged(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, tie): rows dropped, emptied, unpunctuated, repeated or given to the user, by a checksum of conversation and turn."""
    known = {name: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for name, c in (("conv", conv_id), ("turn", turn), ("role", role), ("text", text))}
    kind = F.crc32(F.concat_ws(":", known["conv"], known["turn"])) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), known["role"].alias("role"), known["text"].alias("text"), kind.alias("kind")).filter("kind <> 0")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), digest("role", "text").alias("tie"), F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("*", F.explode("copies")).drop("copies", "col")


def digest(role: str, text: str) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256)


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text), where places follow conversations and turns.

    The row's number is the last key, so that equal rows can be split too.
    """
    keys = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("tie"), F.col("at")]
    sorted_rows = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(lanes(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return settle(sorted_rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("place"), "role", "text"), "turns")


def letters(turns: DataFrame) -> DataFrame:
    """(conv_id, codes): a letter for each row in order, of its speaker and its first fault."""
    body = F.rtrim("text", F.lit(SPACE))
    speaker = F.substring("role", 1, 1)
    compact = turns.select(
        "conv_id",
        "place",
        digest("role", "text").alias("digest"),
        F.when(speaker == "s", SYSTEM).when(speaker == "u", USER).when(speaker == "a", ASSISTANT).otherwise(START).alias("speaker"),
        F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), OK).otherwise(CUT).alias("fault"),
    )
    first = compact.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    coded = compact.join(first, "place", "left").select("conv_id", "place", F.char(F.lit(65) + 4 * fault + F.col("speaker")).alias("code"))

    def gathered(df: DataFrame, keys: list[Column | str], by: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(by, "code")))
        return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("code"))

    segments = gathered(coded.withColumn("segment", F.shiftright("place", SEGMENT_BITS)), ["conv_id", "segment"], "place")
    return gathered(segments, ["conv_id"], "segment").withColumnRenamed("code", "codes")


def step(last: int, speaker: int) -> int | None:
    """Who has spoken last after this speaker, where that is allowed."""
    if speaker == SYSTEM:
        return SYSTEM if last == START else None
    return speaker if speaker != START and NEXT[last] == speaker else None


STEP = [[step(last, speaker) for speaker in range(4)] for last in range(4)]
#: By speaker and fault: the arcs that pass a row, as (letter, cost, the last speakers before, and after)
PASS = {
    (speaker, fault): [("D", DELETE, q, q) for q in range(4)]
    + [(letter, cost + (TRUNCATED if fault == CUT else 0), q, to) for q in range(4) if fault in (OK, CUT) for letter, cost, to in (("K", KEEP, STEP[q][speaker]), ("R", REROLE, NEXT[q])) if to is not None]
    for speaker in range(4)
    for fault in range(4)
}
FORWARD = {key: [sorted((letter, cost, to) for letter, cost, q, to in arcs if q == last) for last in range(4)] for key, arcs in PASS.items()}
BACKWARD = {key: [[(cost, q) for _, cost, q, to in arcs if to == last] for last in range(4)] for key, arcs in PASS.items()}
BEFORE_INSERT = [[q for q in range(4) if NEXT[q] == last] for last in range(4)]
LARGEST = max(cost for arcs in PASS.values() for _, cost, _, _ in arcs)


def distances(rows: list[tuple[int, int]]) -> list[int]:
    """Of each node 4 * rows done + last speaker: the least cost to the end, by Dial's buckets."""
    n = len(rows)
    far = 1 << 60
    least = [far] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(LARGEST + 1)]  # costs ahead lie within the largest arc
    for last in (START, ASSISTANT):
        least[4 * n + last] = 0
        buckets[0].append(4 * n + last)
    now, waiting = 0, 2
    while waiting:
        bucket = buckets[now % (LARGEST + 1)]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if least[node] != now:  # a shorter way was found since
                continue
            done, last = divmod(node, 4)
            arcs = [(INSERT, node - last + q) for q in BEFORE_INSERT[last]]
            if done:
                arcs += [(cost, 4 * done - 4 + q) for cost, q in BACKWARD[rows[done - 1]][last]]
            for cost, to in arcs:
                if now + cost < least[to]:
                    least[to] = now + cost
                    buckets[(now + cost) % (LARGEST + 1)].append(to)
                    waiting += 1
        now += 1
    return least


def least_audit(codes: str) -> tuple[int, str]:
    """The least cost and the first of its audits in ASCII order."""
    rows = [((ord(c) - 65) % 4, (ord(c) - 65) // 4) for c in codes]
    least = distances(rows)
    audit: list[str] = []
    done, last = 0, START
    while True:
        left = least[4 * done + last]
        if done == len(rows) and not left:
            return least[START], "".join(audit)
        passing = FORWARD[rows[done]][last] if done < len(rows) else []
        for letter, cost, to, move in sorted([(letter, cost, to, 1) for letter, cost, to in passing] + [("I", INSERT, NEXT[last], 0)]):
            if left == cost + least[4 * (done + move) + to]:
                audit.append(letter)
                done, last = done + move, to
                break


def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv_id, codes) to the counts of faults, the cost and the audit."""
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    for batch in batches:
        counts: list[list[int]] = [[] for _ in range(5)]
        audits = []
        for value in batch.column(1):
            codes = value.as_py()
            faults = [(ord(c) - 65) // 4 for c in codes]
            speakers = [(ord(c) - 65) % 4 for c in codes]
            cost, audit = least_audit(codes)
            for of, x in zip(counts, (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), sum(p not in legal for p in zip(speakers, speakers[1:])), cost)):
                of.append(x)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(audits, pa.string())], names=["conv_id", *COUNTS, "audit"])


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation comes as its audit (place -1) and then its rows; the repaired lines go into the digest one by one."""
    conv, sha, edits, at, last, lines = None, None, "", 0, START, 0
    done: list[tuple[object, str]] = []

    def say(role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + role + ":").encode())
        sha.update(text.encode())
        lines += 1

    def inserted() -> None:
        nonlocal at, last
        while at < len(edits) and edits[at] == "I":
            last = NEXT[last]
            say(ROLES[last], "")
            at += 1

    def sent(schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], schema.field(0).type), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        done.clear()
        return out

    schema = None
    for batch in batches:
        schema = batch.schema
        for conv_id, place, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if place < 0:
                if sha is not None:
                    inserted()
                    done.append((conv, sha.hexdigest()))
                conv, sha, edits, at, last, lines = conv_id, hashlib.sha256(), role.as_py(), 0, START, 0
                continue
            inserted()
            edit, at = edits[at], at + 1
            if edit == "R":
                last = NEXT[last]
                say(ROLES[last], text.as_py())
            elif edit == "K":
                spoken = role.as_py()
                last = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[spoken[0]]
                say(spoken, text.as_py())
        yield sent(schema)
    if sha is not None:
        inserted()
        done.append((conv, sha.hexdigest()))
        yield sent(schema)


def repair(turns: DataFrame, every: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``every``, from its rows in order."""
    spark = turns.sparkSession
    id_field = T.StructField("conv_id", every.schema["conv_id"].dataType)
    of = letters(turns).withColumnRenamed("conv_id", "_conv")
    known = every.join(of, every["conv_id"].eqNullSafe(of["_conv"]), "left").select("conv_id", F.coalesce("codes", F.lit("")).alias("codes"))
    schema = T.StructType([id_field, *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("audit", T.StringType())])
    audits = settle(known.transform(mapped, audited, schema), "audits")

    stream = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.col("audit").alias("role"), F.lit("").alias("text")).unionByName(turns.select("conv_id", "place", "role", "text"))
    stream = stream.repartition(lanes(spark), "conv_id").sortWithinPartitions("conv_id", "place")
    hashed = stream.transform(mapped, digests, T.StructType([id_field, T.StructField("repaired_sha256", T.StringType())])).withColumnRenamed("conv_id", "_hashed")
    gaps = turns.groupBy(F.col("conv_id").alias("_gaps")).agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    out = audits.join(hashed, audits["conv_id"].eqNullSafe(hashed["_hashed"])).join(gaps, F.col("conv_id").eqNullSafe(F.col("_gaps")), "left")
    return out.select("conv_id", F.coalesce(F.col("gaps").cast("long"), F.lit(0)).alias("gaps"), *COUNTS, "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage by rule, then repair."""
    rows = damaged(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    return repair(in_order(rows), conversations.select(F.col(conv_id).alias("conv_id")).distinct())
