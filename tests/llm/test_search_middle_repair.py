"""Operators 11 to 13 against SQL and brute force."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import conversation_repair as R
from panelwright.llm import fill_middle, pivot_index, queries

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, **tables):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables.get(table, f'{SF}/{table}.parquet')}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    return columns, sorted(want.fetchall(), key=repr)


# Operator 11.


def best_of(queries_, rows, k, scale=256):
    """[(query_id, rank, vec_id, score)] of whole-number products, all pairs."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(x * scale) for x in v]
    found = {(i, tuple(whole(v))) for i, v in rows if i is not None and ok(v)}
    out = []
    for i, v in {(i, tuple(whole(v))) for i, v in queries_ if i is not None and ok(v)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in found if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def searched(spark, queries_, rows, k, **options):
    make = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return sorted(map(tuple, pivot_index.exact_top_k(make(queries_), make(rows), k, **options).select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k_matches_sql(spark):
    columns, want = against_sql(spark, "op11_exact_top_k")
    found = queries.op11_exact_top_k(spark, SF)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == want
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_of_clusters_copies_and_ties(spark, monkeypatch):
    for name, value in {"RING_ROWS": 8, "BLOCK_ROWS": 5, "PACK": 3, "FIRST_CELLS": 1, "GROWTH": 2, "SAMPLE": 60}.items():
        monkeypatch.setattr(pivot_index, name, value)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 5)) * 3
    rows = [(i, (centres[i % 6] + draw.normal(size=5) * 0.1).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies of one vector under many ids
    rows += [(2000 + i, [float(i % 2), 0.0, 0.0, 0.0, 0.0]) for i in range(30)]  # ties
    rows += rows[:10] + [(5, [1.0] * 5), (3000, [0.0] * 5), (3001, []), (3002, [2.0, 1.0])]  # repeats, a second vector of an id, short ones
    asked = rows[::7] + rows[300:312] + [(9000, [float(i) for i in range(5)])]
    assert searched(spark, asked, rows, 4) == best_of(asked, rows, 4)


def test_top_k_prunes_cells_and_visits_none_twice(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "RING_ROWS", 8)
    monkeypatch.setattr(pivot_index, "FIRST_CELLS", 2)
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + draw.normal(size=6) * 0.02).tolist()) for i in range(1200)]
    wanted, whole = [], pivot_index.wanted_cells

    def watch(packs, cells, first, last):
        found = whole(packs, cells, first, last)
        wanted.append((len(cells.number), found.select("cell", F.explode("query_ids").alias("q"))))
        return found

    monkeypatch.setattr(pivot_index, "wanted_cells", watch)
    asked = rows[:24]
    assert searched(spark, asked, rows, 3) == best_of(asked, rows, 3)
    visits = [(r.q, r.cell) for _, df in wanted for r in df.collect()]
    assert len(visits) == len(set(visits)) and len(visits) < 0.5 * len(asked) * wanted[0][0]


def test_top_k_takes_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (50, [-0.5, 0.25])]
    assert searched(spark, rows, rows, 5) == best_of(rows, rows, 5) == [(0, 1, 50, 0), (50, 1, 0, 0)]
    assert searched(spark, rows, [], 5) == searched(spark, [], rows, 5) == searched(spark, [], [], 5) == []
    far = [(i, [(-1.0) ** i * 1e6 * i, 3.0, 1e5]) for i in range(12)]
    assert searched(spark, far, far, 3) == best_of(far, far, 3)
    assert {s for *_, s in searched(spark, [(1, [1e15])], [(2, [1e15]), (3, [-1e15])], 3)} == {2**63 - 1, -(2**63)}
    clash = spark.createDataFrame([(i, [1.0 * i], 1, 2, 3) for i in range(3)], "vec_id long, embedding array<float>, v int, id int, score int")
    assert pivot_index.exact_top_k(clash, clash, 1).count() == 3


# Operator 12.


def test_fill_middle_matches_sql(spark):
    columns, want = against_sql(spark, "op12_fill_middle")
    found = queries.op12_fill_middle(spark, SF)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("members", [[0], list(range(0, 200_000)), list(range(0, 300_000, 3)), [0, 65_535, 65_536, 131_071, 5_000_000], sorted(random.Random(3).sample(range(400_000), 90_000))])
def test_boundary_set_selects_every_rank(members):
    found = fill_middle.BoundarySet.of(np.array(members))
    assert len(found) == len(members)
    ranks = range(len(members)) if len(members) < 100 else random.Random(1).sample(range(len(members)), 300) + [0, len(members) - 1]
    assert [found.select(r) for r in ranks] == [members[r] for r in ranks]
    kinds = {c.kind for c in found.containers}
    assert len(members) < 100_000 or kinds <= {"runs", "bitmap"}
    for key, container in zip(found.keys, found.containers):
        own = [m % 65_536 for m in members if m >> 16 == key]
        size = {"array": 2 * len(own), "bitmap": 8192, "runs": 4 * (1 + sum(b != a + 1 for a, b in zip(own, own[1:])))}
        assert size[container.kind] == min(size.values())


def middle_of(doc_id, text):
    text = text or ""
    units = [u + "\n" for u in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_middle_takes_odd_and_long_texts(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "é\n中文\n\U0001f600x", "has <M> in it\nb", "<\nS>\n<P", "<P\n<S\n<M", "x\r\ny\x00\n" * 5, "line\n" * 300_000 + "end", "\n" * 200_000, "z" * 500_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "p\nq", "x", 1), (3, "\n\n\n", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    assert sorted(map(tuple, fill_middle.transform_digests(docs).collect()), key=repr) == sorted([middle_of(i, t) for i, t, *_ in rows], key=repr)
    back = fill_middle.transform(docs).select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert fill_middle.transform(docs, rate=0).filter("form <> 'plain'").isEmpty()
    assert fill_middle.transform_digests(docs.limit(0)).count() == 0


# Operator 13.

SPACES = " \t\n\x0b\f\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def mended(rows):
    """The report of one conversation, by a search over costs and audits alike."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        left = text.rstrip(SPACES)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            cost, audit = best(i + 1, state)
            found.append((cost + 3, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                more, initial = int(faults[i] == "truncated"), rows[i][2][:1]
                if initial and initial in moves[state]:
                    cost, audit = best(i + 1, initial)
                    found.append((cost + more, "K" + audit))
                to = "a" if state == "u" else "u"
                cost, audit = best(i + 1, to)
                found.append((cost + more + 2, "R" + audit))
        if inserted < 4:
            cost, audit = best(i, "a" if state == "u" else "u", inserted + 1)
            found.append((cost + 2, "I" + audit))
        return min(found) if found else (10**9, "")

    # Costs from the back first, so that the recursion stays flat.
    for i in range(len(rows), -1, -1):
        for n in range(4, -1, -1):
            for state in ("", "s", "u", "a"):
                best(i, state, n)
    cost, audit = best(0, "")
    state, place, out = "", 0, []
    for edit in audit:
        if edit in "IR":
            state = "a" if state == "u" else "u"
            out.append(("assistant" if state == "a" else "user") + ":" + ("" if edit == "I" else rows[place][3]))
        elif edit == "K":
            state = rows[place][2][0]
            out.append(f"{rows[place][2]}:{rows[place][3]}")
        place += edit != "I"
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def report_of(rows):
    left = harmed(rows)
    return sorted([(conv, *mended([r for r in left if r[0] == conv])) for conv in {r[0] for r in rows}], key=repr)


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, copy string").repartition(3)
    return sorted(map(tuple, R.repair_report(df, R.damaged(df)).collect()), key=repr), df


def test_repair_matches_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted(map(tuple, queries.op13_conversation_repair(spark, SF).collect()), key=repr)
    assert found == report_of(rows)


def wild(seed, n, convs):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "ok.\n", "é中."]
    return [(draw.choice(convs), draw.choice([None, draw.randrange(n)]) if draw.random() < 0.1 else i, draw.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), draw.choice([None, *texts, *[f"{i}." for i in range(30)]])) for i in range(n)]


@pytest.mark.parametrize("rows_of_a_chunk", [1, 3, 1024])
def test_repair_matches_brute_force_on_wild_rows(spark, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(R, "CHUNK_ROWS", rows_of_a_chunk)
    rows = wild(5, 260, [0, 1, 1, 1, 2, 3, None]) + [(77, 0, None, None)] + [(100 + i, i % 3, "user", "Hi.") for i in range(40)]
    found, df = repaired(spark, rows)
    assert found == report_of(rows)
    # Messages of the repair are those that were hashed, and its roles are legal.
    by_conv = {}
    for r in R.repaired_messages(R.damaged(df)).orderBy("conv_id", "place").collect():
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digest = lambda v: hashlib.sha256("\n".join(v).encode()).hexdigest()
    assert {r[0]: r[-1] for r in found} == {r[0]: digest(by_conv.get(r[0], [])) for r in found}


def test_fix_up_passes_end_where_vectors_differ_by_a_constant():
    draw = random.Random(9)
    for _ in range(300):
        codes = bytes(draw.choice([0, 1, 1, 2, 2, 3, 4, 5, 8 + 1, 8 + 2]) for _ in range(draw.randrange(1, 40)))
        behind = tuple(draw.choice([0, 1, 2, 4]) for _ in range(4))
        behind = tuple(v - min(behind) for v in behind)
        before, total = R.run_back(codes, R.END)
        assert R.fix_up(codes, R.END, before, total, behind) == R.run_back(codes, behind)
    long = bytes([1, 2] * 5000)
    runs = []
    was = R.before_row
    try:
        R.before_row = lambda *a: runs.append(1) or was(*a)
        before, total = R.run_back(long, R.END)
        runs.clear()
        R.fix_up(long, R.END, before, total, (0, 1, 0, 3))
    finally:
        R.before_row = was
    assert len(runs) < 20


def test_one_conversation_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_ROWS", 16)
    rows = wild(6, 1500, [4])
    assert repaired(spark, rows)[0] == report_of(rows)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair_report(empty, R.damaged(empty)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found, _ = repaired(spark, [(gone, 0, "user", "Hi.")])
    assert found == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())] == report_of([(gone, 0, "user", "Hi.")])
