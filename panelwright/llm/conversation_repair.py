"""Conversation structure repair by the cheapest edits, found by a rank-convergence parallel Viterbi.

A conversation is a sequence of rows; edits keep, rerole or delete each and insert empty ones, so that role initials read
`(s?(ua)+)?`. Four states say what the repaired part ends in: nothing, system, user, assistant. The cost of finishing from each
state is a vector; a row turns the vector behind it into the one before it, and only differences between its entries matter.

* Rows are sorted by conversation and turn in ranges, and runs of one conversation are cut into chunks. A chunk of few bytes a
  row holds all that costs depend on.
* Every chunk runs backward from a speculative vector, that of a conversation's end. Fix-up passes run those chunks again whose
  right neighbour came to another vector, and stop in a chunk where old and new vectors differ only by a constant; passes end
  when every chunk has its neighbour's vector. Constants are summed by conversation.
* With its vectors settled, each chunk traces the cheapest edits of least audit from all four states. One ordered pass over the
  chunks of a conversation follows the states, applies the edits to the texts and hashes what is left.

Rows stand in the order of turn (nulls first), role, text. A null conv_id is a conversation of its own; a null role or text is one
space. Roles of no letter can't be kept. Rows that repeat role and text of an earlier one are duplicates, equal rows too. An empty
table gives no rows; other columns of the table aren't read. Long texts stand alone in a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import map_arrow, map_batches, stored

#: Rows of a chunk at most.
CHUNK_ROWS = 1024
SPACES = " \t\n\x0b\f\r"
INITIALS = "sua"
#: Bits of a row's code beside the place of its role's initial in INITIALS (3: none of them).
MUST_DELETE, TRUNCATED = 4, 8
#: What a repaired part ends in, the state after a user or assistant row is added to each, and after a kept row of each initial.
START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = (USER, USER, ASSISTANT, USER)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: Costs of finishing behind the last row, with insertions there.
END = (0, 4, 2, 0)
REROLE = INSERT = 2
DELETE = 3

Vector = tuple[int, int, int, int]


def _row_costs(code: int, behind: Vector, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost to finish, state) of what can be done with a row."""
    found = [("D", DELETE + behind[state], state)]
    if not code & MUST_DELETE:
        more, kept = int(bool(code & TRUNCATED)), KEPT.get((state, code & 3))
        if kept is not None:
            found.append(("K", more + behind[kept], kept))
        found.append(("R", REROLE + more + behind[ADDED[state]], ADDED[state]))
    return found


@lru_cache(maxsize=1 << 16)
def before_row(code: int, behind: Vector) -> tuple[Vector, int]:
    """The vector before a row, its least entry taken off, and that entry."""
    plain = [min(c for _, c, _ in _row_costs(code, behind, s)) for s in range(4)]
    costs = []
    for state in range(4):
        best, at = plain[state], state
        for n in (1, 2):  # a third insertion is back in the state of the first
            at = ADDED[at]
            best = min(best, n * INSERT + plain[at])
        costs.append(best)
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def least_edits(code: int, behind: Vector, state: int) -> tuple[str, int]:
    """The cheapest edits of a row and of insertions before it that come first in ASCII, and the state behind them."""
    vector, taken = before_row(code, behind)
    done = ""
    while True:
        left = vector[state] + taken
        options = _row_costs(code, behind, state) + [("I", INSERT + vector[ADDED[state]] + taken, ADDED[state])]
        edit, _, state = min(o for o in options if o[1] == left)
        done += edit
        if edit != "I":
            return done, state


def run_back(codes: bytes, behind: Vector) -> tuple[Vector, int]:
    """The vector before a chunk from the one behind it, and the constant between them."""
    total = 0
    for code in reversed(codes):
        behind, taken = before_row(code, behind)
        total += taken
    return behind, total


def fix_up(codes: bytes, old_behind: Vector, old_before: Vector, old_total: int, behind: Vector) -> tuple[Vector, int]:
    """What run_back gives from behind, run only until the vectors are those of the earlier run from old_behind but for a constant."""
    total = earlier = 0
    for code in reversed(codes):
        if behind == old_behind:
            return old_before, old_total + total - earlier
        behind, taken = before_row(code, behind)
        old_behind, old_taken = before_row(code, old_behind)
        total, earlier = total + taken, earlier + old_taken
    return behind, total


def trace(codes: bytes, behind: Vector, last: bool) -> tuple[list[str], list[int]]:
    """From each state: the edits of a chunk, one of D, K or R a row with insertions before it, and the state behind it."""
    vectors = []
    at = behind
    for code in reversed(codes):
        vectors.append(at)
        at = before_row(code, at)[0]
    audits, ends = [], []
    for state in range(4):
        edits = []
        for code, vector in zip(codes, reversed(vectors)):
            edit, state = least_edits(code, vector, state)
            edits.append(edit)
        while last and END[state]:
            edits.append("I")
            state = ADDED[state]
        audits.append("".join(edits))
        ends.append(state)
    return audits, ends


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32(`conv_id:turn`) % 20, nulls as one space.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?` away, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def chunked(rows: DataFrame) -> DataFrame:
    """(chunk, conv_id, roles, texts, digests, codes, turns) in the shared folder: sorted runs of one conversation each.

    Chunks are numbered in the order of all rows. Codes don't know of duplicates yet; digests tell equal rows of a conversation.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    ends = F.substring(trimmed, -1, 1)
    code = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, F.lit(i)) for i, c in enumerate(INITIALS)], F.lit(3))
    code = code + F.when(trimmed == "", F.lit(MUST_DELETE)).when(ends.isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(TRUNCATED))
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    key = ["conv_id", "turn", "role", "text"]
    order = rows.repartitionByRange(*key).sortWithinPartitions(*key).select(*key, digest.alias("digest"), code.cast("tinyint").alias("code"))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("conv_id").to_pylist()
        starts = [0]
        for i in range(1, len(ids)):
            if ids[i] != ids[i - 1] or i - starts[-1] == CHUNK_ROWS:
                starts.append(i)
        offsets = pa.array([*starts, len(ids)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("role", "text", "digest", "turn")]
        codes = batch.column("code").to_numpy().astype(np.uint8).tobytes()
        packed = pa.array([codes[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(starts)), *lists, packed], names=["conv_id", "roles", "texts", "digests", "turns", "codes"])

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = f"conv_id {conv}, roles array<string>, texts array<string>, digests array<binary>, turns array<{turn}>, codes binary"
    return stored(map_arrow(order, cut, schema).withColumn("chunk", F.monotonically_increasing_id()), "conversation-chunks")


def repeated_places(chunks: DataFrame) -> DataFrame:
    """(chunk, places): where rows of a chunk repeat role and text of an earlier row of their conversation."""
    light = chunks.select("chunk", F.posexplode("digests").alias("place", "digest"))
    place = F.struct("chunk", "place")
    several = light.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = light.join(stored(several, "repeated-rows"), "digest").filter(place > F.col("first"))
    return met.groupBy("chunk").agg(F.collect_list("place").alias("places"))  # CHUNK_ROWS at most


def coded(chunks: DataFrame) -> DataFrame:
    """(chunk, conv_id, codes, next, counts...) in the shared folder: all that costs depend on, a byte a row.

    next is the conversation's following chunk. blank, duplicate, truncated and illegal count rows; turns that chunks share are counted once.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for codes, places in zip(batch.column("codes").to_pylist(), batch.column("places").to_pylist()):
            code = np.frombuffer(codes, np.uint8)
            blank = (code & MUST_DELETE) > 0
            repeats = np.zeros(len(code), bool)
            repeats[places or []] = True
            repeats &= ~blank
            cut = ((code & TRUNCATED) > 0) & ~repeats
            initial = code & 3
            illegal = sum((int(a), int(b)) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initial[:-1], initial[1:]))
            final = initial | np.where(blank | repeats, MUST_DELETE, 0).astype(np.uint8) | np.where(cut, TRUNCATED, 0).astype(np.uint8)
            out.append((final.tobytes(), int(blank.sum()), int(repeats.sum()), int(cut.sum()), illegal, int(initial[0]), int(initial[-1])))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = ["codes", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial"]
        kept = ["chunk", "conv_id", "turns"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=[*kept, *names])

    conv, turns = (chunks.schema[c].dataType.simpleString() for c in ("conv_id", "turns"))
    rows = chunks.select("chunk", "conv_id", "turns", "codes").join(repeated_places(chunks), "chunk", "left")
    schema = f"chunk bigint, conv_id {conv}, turns {turns}, codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial int, last_initial int"
    found = map_arrow(rows.select("chunk", "conv_id", "turns", "codes", "places"), count, schema)
    known = F.array_distinct(F.filter("turns", lambda t: t.isNotNull()))
    columns = {"first_turn": F.get("turns", 0), "last_turn": F.element_at("turns", -1), "min_turn": F.array_min("turns"), "max_turn": F.array_max("turns"), "n_turns": F.size(known)}
    base = stored(found.withColumns(columns).drop("turns"), "conversation-codes")
    w = Window.partitionBy("conv_id").orderBy("chunk")
    light = base.select("chunk", "conv_id", "first_initial", "last_initial", "first_turn", "last_turn")
    legal = F.concat(F.lag("last_initial").over(w).cast("string"), F.col("first_initial").cast("string")).isin("01", "12", "21")
    links = light.select("chunk", F.lead("chunk").over(w).alias("next"), (~legal).cast("int").alias("broken"), (F.lag("last_turn").over(w) == F.col("first_turn")).cast("int").alias("shared"))
    whole = base.drop("first_initial", "last_initial", "first_turn", "last_turn").join(links, "chunk")
    whole = whole.withColumns({"illegal": F.col("illegal") + F.coalesce("broken", F.lit(0)), "n_turns": F.col("n_turns") - F.coalesce("shared", F.lit(0))})
    return stored(whole.drop("broken", "shared"), "linked-codes")


_VECTORS = "chunk bigint, next bigint, behind array<int>, before array<int>, total bigint"


def settled_vectors(codes: DataFrame) -> DataFrame:
    """(chunk, next, behind, before, total): each chunk's vectors behind and before it, as its neighbours have them, and the constant between."""

    def vectors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = "behind" not in batch.schema.names
        out = []
        for row in batch.to_pylist():
            behind = END if first else tuple(row["wanted"])
            before, total = run_back(row["codes"], END) if first else fix_up(row["codes"], tuple(row["behind"]), tuple(row["before"]), row["total"], behind)
            out.append((row["chunk"], row["next"], behind, before, total))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["chunk", "next", "behind", "before", "total"])

    now = stored(map_arrow(codes.select("chunk", "next", "codes"), vectors, _VECTORS), "vectors")
    while True:
        neighbour = now.select(F.col("chunk").alias("next"), F.col("before").alias("wanted"))
        # Chunks with a next one are few: of conversations that were cut.
        moved = stored(now.filter("next IS NOT NULL").join(neighbour, "next").filter("behind <> wanted"), "vectors-to-fix")
        if moved.isEmpty():
            return now
        again = map_arrow(codes.select("chunk", "codes").join(moved, "chunk"), vectors, _VECTORS)
        now = stored(now.join(moved.select("chunk"), "chunk", "left_anti").unionByName(again), "vectors")


def traced(codes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(conv_id, chunk, audits, ends): of each chunk the edits from every state and the states that they lead to."""

    def follow(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [trace(row["codes"], tuple(row["behind"]), row["next"] is None) for row in batch.select(["codes", "behind", "next"]).to_pylist()]
        columns = [pa.array([a for a, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), *columns], names=["conv_id", "chunk", "audits", "ends"])

    rows = codes.select("chunk", "conv_id", "codes").join(vectors.select("chunk", "next", "behind"), "chunk")
    return map_arrow(rows, follow, f"conv_id {codes.schema['conv_id'].dataType.simpleString()}, chunk bigint, audits array<string>, ends array<int>")


def _applied(edits: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """(role, text) of what the edits leave of a chunk's rows."""
    out, place = [], 0
    for edit in edits:
        if edit in "IR":
            role = "assistant" if state == USER else "user"
            out.append((role, "" if edit == "I" else texts[place]))
            state = ADDED[state]
        elif edit == "K":
            out.append((roles[place], texts[place]))
            state = SYSTEM if state == START and roles[place][:1] == "s" else ADDED[state]
        place += edit != "I"
    return out


def repaired(chunks: DataFrame, traces: DataFrame, messages: bool = False) -> DataFrame:
    """(conv_id, audit, repaired_sha256), or with messages (conv_id, place, role, text), of every conversation with rows.

    Edits and texts of a chunk meet in the order of chunks, in a stream of one conversation after another: a task holds one chunk
    of texts at a time, and a conversation's audit, which is a cell of the result.
    """
    conv = chunks.schema["conv_id"].dataType
    kind = pa.int64() if conv.simpleString() == "bigint" else pa.int32() if conv.simpleString() == "int" else pa.string()
    texts = chunks.select("conv_id", "chunk", F.lit(1).alias("kind"), "roles", "texts", F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("array<int>").alias("ends"))
    edits = traces.select("conv_id", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("array<string>").alias("texts"), "audits", "ends")
    rows = texts.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state, audit, place, digest, audits, ends = None, False, START, [], 0, None, None, None

        def closed() -> pa.RecordBatch:
            columns = [pa.array([now], kind), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != now:
                    if begun and not messages:
                        yield closed()
                    now, begun, state, audit, place, digest = row["conv_id"], True, START, [], 0, hashlib.sha256()
                if row["kind"] == 0:
                    audits, ends = row["audits"], row["ends"]
                    continue
                left = _applied(audits[state], row["roles"], row["texts"], state)
                audit.append(audits[state])
                state = ends[state]
                if messages:
                    columns = [pa.array([now] * len(left), kind), pa.array(range(place, place + len(left)), pa.int64()), pa.array([r for r, _ in left], pa.string()), pa.array([t for _, t in left], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text"])
                elif left:
                    digest.update(("\n" if place else "").encode() + "\n".join(f"{r}:{t}" for r, t in left).encode())
                place += len(left)
        if begun and not messages:
            yield closed()

    schema = "place bigint, role string, text string" if messages else "audit string, repaired_sha256 string"
    return map_batches(rows, stream, f"conv_id {conv.simpleString()}, {schema}")


def solved(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, codes, vectors, traces) of rows (conv_id, turn, role, text)."""
    chunks = chunked(rows)
    codes = coded(chunks)
    vectors = settled_vectors(codes)
    return chunks, codes, vectors, traced(codes, vectors)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): conversations after the cheapest repair, in order from place 0."""
    chunks, _, _, traces = solved(rows)
    return repaired(chunks, traces, messages=True)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conversation of conversations: faults, cost, audit and digest of the repair of its rows, zeros and empty ones if it has none."""
    chunks, codes, vectors, traces = solved(rows)
    totals = codes.join(vectors.select("chunk", "before", "total"), "chunk").groupBy("conv_id").agg(
        F.when(F.max("max_turn").isNotNull(), F.max("max_turn") - F.min("min_turn") + 1 - F.sum("n_turns")).otherwise(F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        (F.sum("total") + F.min_by(F.get("before", START), "chunk")).cast("bigint").alias("cost"),
    )
    ids = conversations.select("conv_id").distinct().alias("a")
    found = ids.join(totals.alias("b"), _same(F.col("a.conv_id"), F.col("b.conv_id")), "left").join(repaired(chunks, traces).alias("c"), _same(F.col("a.conv_id"), F.col("c.conv_id")), "left")
    zeros = [F.coalesce(F.col(f"b.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return found.select("a.conv_id", *zeros, *[F.coalesce(F.col(f"c.{c}"), F.lit(v)).alias(c) for c, v in empty.items()])
