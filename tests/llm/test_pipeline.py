import random

import pytest

import corpus_pipeline
from panelwright.llm import near_copies, toxicity
from panelwright.llm.common import DOC_COLUMNS, table
from panelwright.llm.queries import line_dedup, simhash

SF = "/root/testdata/sf0.001"


def brute_firsts(texts):
    """The least id of each group that five-word similarities of 0.8 or more link, and the number of links."""

    def shingles(text):
        found = (text or "").lower().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}

    sets = {i: shingles(t) for i, t in texts.items()}
    group, linked = {i: i for i in sets}, 0

    def first(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((first(i), first(j)))
                group[y] = x
                linked += 1
    return sorted(i for i in sets if first(i) == i), linked


def test_stages_are_their_operators(spark):
    docs = table(spark, SF, "documents").cache()
    model = toxicity.train(docs, table(spark, SF, "labels"))
    predicted = {r.doc_id: r.predicted for r in toxicity.scores(docs, model).collect()}
    one = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert {r.doc_id for r in one.collect()} == {i for i, p in predicted.items() if not p}
    two = corpus_pipeline.drop_lines(spark, one, SF).cache()
    assert two.count() == one.count() and all(r.n_chars == len(r.text or "") for r in two.collect())
    shorter = {r.doc_id: r.text for r in line_dedup.drop_frequent_lines(one).collect()}
    assert {r.doc_id: r.text for r in two.collect()} == shorter
    three = corpus_pipeline.drop_near_duplicates(spark, two, SF).cache()
    firsts = brute_firsts({r.doc_id: r.text for r in two.collect()})[0]
    assert sorted(r.doc_id for r in three.collect()) == firsts
    four = corpus_pipeline.mix_sources(spark, three, SF).cache()
    assert {r.doc_id for r in four.collect()} <= set(firsts)
    for frame in (one, two, three, four):
        assert tuple(frame.columns) == DOC_COLUMNS
    five = corpus_pipeline.encode_tokens(spark, four, SF)
    assert five.count() == four.count()


def test_stages_take_odd_rows_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "src1", 0), (1, "", "en", "src1", 0), (2, "a b c d", None, "src2", 7), (3, "a b c d", "de", None, 7), (4, "x " * 3000, "en", "src1", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            now.count()
    kept = simhash.representatives(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept) == [(False, 1, ""), (False, 2, "a b c d"), (False, 4, "x " * 3000)]


def test_near_duplicates_are_those_of_brute_force(spark):
    random_ = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "a b c", "A  b c", "a b c d"]
    for _ in range(60):
        base = random_.choices(words, k=random_.choice([8, 40, 120, 300]))
        for _ in range(random_.randint(1, 8)):
            copy = base[:]
            for _ in range(random_.choice([0, 1, 1, 2, 3, 6])):
                copy[random_.randrange(len(copy))] = random_.choice(words)
            texts.append(" ".join(copy[: random_.choice([len(copy), len(copy) * 9 // 10])]))
    texts += [" ".join([*words[:150], *random_.choices(words, k=random_.choice([5, 10, 15, 20]))]) for _ in range(120)]  # one crowded group
    random_.shuffle(texts)

    want, linked = brute_firsts(dict(enumerate(texts)))
    assert linked > 1000 and len(want) < len(texts) - 100
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == want
    crowded = near_copies.representatives(docs, hot=3)
    assert sorted(r.doc_id for r in crowded.collect()) == want


def test_a_run_goes_on_after_its_last_complete_stage(spark, tmp_path, monkeypatch):
    rows = [(i, f"some words of document {i} " * 20, "en", f"src{i % 3}", 9) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    called = []

    def counted(name, stage, broken):
        def call(*args):
            called.append(name)
            if broken and name == broken[0]:
                raise RuntimeError("lost")
            return stage(*args)

        return name, call

    broken = ["mixing"]
    run_id = tmp_path.name
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s, broken) for s in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), run_id)
    broken.clear()
    assert corpus_pipeline.run(spark, str(tmp_path), run_id).count() == 30
    assert called == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "mixing", "byte_bpe"]


def test_near_duplicate_stage_takes_operator_8s_candidates(spark):
    from pyspark.sql import functions as F

    from panelwright.llm.simhash import majority

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(f"v{i}" for i in range(400))]
    sets = [near_copies.shingles(t) for t in texts]
    prints = [majority(s) for s in sets]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    marked = near_copies._nodes(docs, "doc_id", "text", near_copies.WIDTH)
    nodes = {r.doc_id: r.node for r in marked.collect()}
    pairs = [tuple(r) for r in near_copies.print_pairs(marked.select("node", "fp")).collect()]
    assert pairs == [tuple(sorted((nodes[0], nodes[1])))]
    # Without a single key of minima the stage still links what operator 8 finds.
    bare = marked.withColumn("keys", F.array().cast("array<bigint>")).select("node", "n", "fp", "keys")
    found = near_copies.links(bare, marked.join(docs, "doc_id").select("node", "text"))
    assert [tuple(r) for r in found.collect()] == pairs
