import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import bpe, line_dedup, mixing, near_copies, quality_rules, queries, simhash, slices
from panelwright.llm.pretokenize import pretokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n", "a", "x" * 5000, "it's we'll 'S\t\tdon't''s  ", "中文 données 12³ \x00\x1c", " \n end ", "the the the the"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_match_the_pattern():
    pattern, random_ = regex.compile(public_tokenizers.PATTERN), random.Random(5)
    texts = ["".join(random_.choices(" '\n\t.!stmdrevl1²é中 \x00\x1c", k=random_.randint(0, 60))) for _ in range(3000)]
    assert list(pretokens(texts, 777)) == [pattern.findall(t) for t in texts]


def test_bpe_matches_the_library(spark):
    own, coder = library(), bpe.codec(RANKS)
    random_ = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(random_.choices("abcdefgh ", k=n)) for n in (300, 3000)] + ["".join(random_.choices("abcde", k=2000))]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == own.encode_ordinary(text)
        offsets = coder.offsets(ids)
        assert coder.decode(ids) == text.encode()
        assert coder.decode_span(ids, offsets, 1, 4) == text.encode()[1:4]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs, RANKS).collect()}
    for i, t in enumerate(ODD):
        ids = own.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert [r.decoded for r in sorted(again, key=lambda r: r.doc_id)] == [t or "" for t in ODD]
    assert bpe.round_trip_digests(docs.limit(0), RANKS).count() == 0


def test_every_code_point_is_encoded_as_the_library_does():
    own, coder = library(), bpe.codec(RANKS)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}'s {c}1 !{c} " for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == own.encode_ordinary(text), text


def test_slices_have_their_own_codes_in_a_crowded_table(monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 40)
    random_, calls = random.Random(4), []

    def make(found):
        calls.append(found)
        return [np.frombuffer(s, np.uint8).astype(np.uint32)[::-1] for s in found]

    cache = slices.SliceCodes(make, slot_bits=7)
    for _ in range(30):
        parts = ["".join(random_.choices("ab\0", k=random_.choice([1, 2, 3, 8, 22, 23, 24, 60]))).encode() for _ in range(random_.randint(0, 150))]
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        begins = np.append(0, ends)[: len(parts)]
        codes, counts = cache.codes(b"".join(parts) + b"\0" * slices.PADDING, begins, ends)
        assert counts.tolist() == [len(p) for p in parts]
        assert codes.tolist() == [b for p in parts for b in reversed(p)]
    assert all(len(set(c)) == len(c) for c in calls)


def naive_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in prints}


def corpus(seed=3):
    random_ = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    texts = ["", "  \n", "One", "one TWO", "İ One two three"]
    for _ in range(12):
        words = random_.choices(vocabulary, k=random_.randint(60, 150))
        for _ in range(8):
            copy = list(words)
            for _ in range(random_.randint(0, 3)):
                copy[random_.randrange(len(copy))] = random_.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def test_simhash_matches_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i * 7 % 1000, t, 0) for i, t in enumerate(texts)] + [(5000, None, 1)], "doc_id long, text string, fp int")
    prints = {r.doc_id: naive_fingerprint(r.text or "") for r in docs.collect()}
    want = brute_components(prints)
    for hot in (simhash.HOT, 3, 1):
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs, hot=hot).collect()}
        assert got == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(want)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_are_all_pairs_within_two_bits(spark):
    random_, prints = random.Random(6), set()
    for _ in range(12):
        base = random_.getrandbits(64)
        for _ in range(25):
            flips = random_.sample(range(64), random_.choice([0, 1, 1, 2, 3])) if random_.random() < 0.7 else random_.sample(range(32, 64), 2)
            prints.add(base ^ sum(1 << b for b in flips))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    want = {(a, b) for a in signed for b in signed if a < b and (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 2}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for hot in (simhash.HOT, 5, 1):
        assert sorted((r.src, r.dst) for r in simhash.links(nodes, hot).collect()) == sorted(want)
    assert len(want) > 400


def test_simhash_lone_long_chain(spark):
    prints = [0, 3, 15, 63, 255, 1 << 63, (1 << 63) | 1, 0xFFFF << 20]
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for hot in (256, 1):
        labels = simhash.connected_components(simhash.links(nodes, hot)).collect()
        groups = {}
        for r in labels:
            groups.setdefault(r.component, set()).add(r.node % (1 << 64))
        assert sorted(map(sorted, groups.values())) == [sorted({0, 3, 15, 63, 255, 1 << 63, (1 << 63) | 1})]


def test_line_dedup_matches_brute_force(spark):
    random_ = random.Random(1)
    pool = ["License X", "  license x\t", "LICENSE x", "", " ", "é", "É", "unique", "b c"] + ["line %d" % i for i in range(30)]
    texts = ["\n".join(random_.choices(pool, k=random_.randint(0, 9))) for _ in range(40)] + [None, "", "\n", "\n\n", "b c"]
    texts += texts[:3]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_dropped int")
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    for least, batches in ((4, 1), (4, 5), (1, 2), (10, 4)):
        counts = {}
        for t in texts:
            for k in {key(x) for x in (t or "").split("\n")}:
                counts[k] = counts.get(k, 0) + 1
        gone = {k for k, n in counts.items() if k and n >= least}
        got = {r.doc_id: r for r in line_dedup.drop_frequent_lines(docs, min_documents=least, batches=batches).collect()}
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            kept = [x for x in lines if key(x) not in gone]
            assert (got[i].n_lines, got[i].n_dropped, got[i].text or "") == (len(lines), len(lines) - len(kept), "\n".join(kept)), (i, t)
    assert line_dedup.drop_frequent_lines(docs.limit(0)).count() == 0


def test_line_runs_are_merge_joined_without_shuffling_a_run(spark):
    runs, want, random_ = line_dedup.LineRuns(spark, 10), {}, random.Random(1)
    for i in range(7):
        keys = [(random_.randint(0, 300) ** 2 // 400, 0) for _ in range(400)]
        for k in keys:
            want[k[0]] = want.get(k[0], 0) + 1
        runs.add(spark.createDataFrame(keys, "a long, b long"))
    assert [bool(r) for r in runs.levels] == [True, True, True]
    batch = spark.createDataFrame([(1, 0)], "a long, b long").groupBy("a", "b").count()
    sides = ((batch.join(runs._settled(runs.levels[2]), ["a", "b"], "left_anti"), 1), (runs._merged(runs._counts(runs.levels[2]), runs._counts(runs.levels[1])), 0))
    for joined, of_batch in sides:
        with runs.in_order():
            plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == plan.count("Sort [") == of_batch, plan
    assert sorted(r.a for r in runs.frequent().collect()) == sorted(k for k, n in want.items() if n >= 10)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(i, "one two three", "en", "src1", 13, i, i, i, i) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long, _lines_row int, _hash int, _mix_tokens int, __lines_row int")
    assert line_dedup.drop_frequent_lines(docs).select("_lines_row", "__lines_row", "_hash").distinct().count() == 12
    assert set(simhash.representatives(docs).columns) == set(docs.columns)
    mixed = mixing.mixed_documents(docs, mixing.Mixture(max_epochs=1), mixing.domain_of_source(F.col("source")))
    assert mixed.columns == docs.columns and mixed.select("_mix_tokens", "_hash").distinct().count() == 12
    assert near_copies.representatives(docs).columns == docs.columns and near_copies.representatives(docs).count() == 1


def test_clashing_names_do_not_reach_the_rules(spark):
    plain = spark.createDataFrame([(1, " ".join("w%d" % i for i in range(80))), (2, None), (3, "### %% " * 60)], "doc_id long, text string")
    clash = plain.select("*", *[F.lit("x").alias(c) for c in ("n_words", "kept", "rejected_by", "base_failed", "n_symbols", "words", "lines", "cost")])
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = lambda df: sorted(map(tuple, quality_rules.quality_verdicts(df).select(*names).collect()))
    assert rows(clash) == rows(plain) and len(rows(clash)) == 3


def naive_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})


def test_quality_counts_and_verdicts(spark):
    random_ = random.Random(4)
    texts = [None, "", "# $ x\nx\n x\nx", *[" ".join(random_.choices("abcd", k=n)) for n in (3, 10, 60)], " ".join("w%d" % i for i in range(80)), "\x85 a b"]
    texts += ["\n".join(["same line of words"] * 4 + ["w%d v%d u%d" % (i, i, i) for i in range(40)]), "### %% " * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    for i, t in enumerate(texts):
        words = [w for w in regex.split(r"[\x20\x09-\x0D]+", t or "") if w]
        assert got[i].n_words == len(words) and got[i].n_repeat_words == naive_repeats(words)
        lines = [x for x in (t or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].base_failed == (len(words) < 50 or 100 * got[i].n_repeat_words > 50 * len(words))
    assert got[6].kept and not got[9].kept and not got[0].kept
    flipped = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs, rules=quality_rules.RULES[::-1], sample=1).collect()}
    assert flipped == {i: r.kept for i, r in got.items()}
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0


def test_cascade_order_is_rejections_per_second_of_what_is_left():
    found = list(range(100))
    spans = {"a": (0, 40), "b": (0, 50), "c": (50, 60), "d": (0, 0)}
    rules = tuple(quality_rules.Rule(n, lambda d, s=s: s[0] <= d < s[1]) for n, s in spans.items())
    one_second = lambda left, rule: ([d for d in left if not rule.rejects(d)], 1.0)
    assert [r.name for r in quality_rules.ordered(rules, found, one_second)] == ["b", "c", "a", "d"]
    slow_b = lambda left, rule: ([d for d in left if not rule.rejects(d)], 9.0 if rule.name == "b" else 1.0)
    assert [r.name for r in quality_rules.ordered(rules, found, slow_b)] == ["a", "c", "b", "d"]


def test_quality_letters_are_those_of_sql(spark, tmp_path):
    connection = duckdb.connect()
    words = ["½7", "x²", "²", "ª", "中", "Ⅷ", "ⓐ", "é", "_", "٣", "a1"]
    texts = [" ".join([*[f"w{i}" for i in range(n)], *[w + str(i) for i in range(60 - n)]]) for w in words for n in (20, 41, 42, 50)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1] for r in connection.execute(f"select doc_id, kept from ({queries.OP5_SQL})").fetchall()}
    got = {r.doc_id: r.kept for r in queries.op5_quality_rules(spark, str(tmp_path)).collect()}
    assert got == want and set(want.values()) == {True, False}
