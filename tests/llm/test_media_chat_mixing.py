import hashlib
import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import chat_format, media, mixing, queries, toxicity
from panelwright.llm import progressive_jpeg as jpeg


def same(spark_rows, sql, **tables):
    connection = duckdb.connect()
    for name, frame in tables.items():
        connection.register(name, frame.toPandas())
    want = connection.execute(sql)
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in spark_rows.collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 40, 333])
def test_jpeg_keeps_payloads(n):
    payloads = [np.random.default_rng(n).bytes(192 * n), b" " * 192 * n, b"\xff" * 192]
    files = jpeg.encode(payloads)
    images, coefficients = jpeg.coefficients_of(files)
    assert [jpeg.payload_of(i, coefficients) for i in images] == payloads
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)
    for image, tensor in zip(images, jpeg.tensors(images, coefficients)):
        assert tensor.shape == (image.height, image.width, 3)


def test_jpeg_samples_match_the_textbook_transform():
    zigzag = jpeg.zigzag()
    assert zigzag[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(zigzag) == list(range(64))
    block = np.zeros((1, 64), np.int64)
    values = np.random.default_rng(1).integers(-40, 40, 64)
    block[0] = values
    grid = np.zeros((8, 8))
    grid.ravel()[zigzag] = values
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            want[y, x] = sum(
                (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                for u in range(8)
                for v in range(8)
            )
    got = jpeg._samples(block).reshape(8, 8)
    assert np.abs(got - np.clip(want + 128, 0, 255)).max() <= 1


def _bit_writer():
    bits = []

    def put(value, n):
        bits.extend(value >> (n - 1 - i) & 1 for i in range(n))

    def done():
        bits.extend([1] * (-len(bits) % 8))
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") if bits else b""

    return put, done


def test_jpeg_decoder_takes_zero_runs_and_new_coefficients_in_refinement():
    """A file with zero runs, long runs, end-of-band runs over blocks and coefficients that appear late."""
    rng = np.random.default_rng(7)
    blocks = np.zeros((6, 64), np.int64)
    for b in blocks[:5]:
        b[rng.integers(1, 64, 6)] = rng.integers(-9, 10, 6)
    blocks[2, 1:] = 0
    blocks[3, 63] = -5
    blocks[:, 0] = rng.integers(-50, 50, 6)
    dc = {4: list(range(12))}
    ac = {8: sorted({r << 4 | s for r in range(16) for s in range(5)})[:80]}
    dc_codes, ac_codes = jpeg.canonical(dc), jpeg.canonical(ac)
    put, done = _bit_writer()
    last = 0
    for b in blocks:
        diff, last = int(b[0]) - last, int(b[0])
        size = abs(diff).bit_length()
        put(*dc_codes[size])
        put(diff if diff > 0 else diff + (1 << size) - 1, size)
    dc_data = done()
    shrink = lambda v: int(np.sign(v)) * (abs(int(v)) >> 1)
    put, done = _bit_writer()
    pending = 0

    def flush():
        nonlocal pending
        while pending:
            n = min(pending, 32767).bit_length() - 1
            put(*ac_codes[n << 4])
            put(pending - (1 << n), n)
            pending = 0

    for b in blocks:
        run = 0
        for k in range(1, 64):
            v = shrink(b[k])
            if v == 0:
                run += 1
                continue
            flush()
            while run > 15:
                put(*ac_codes[0xF0])
                run -= 16
            size = abs(v).bit_length()
            put(*ac_codes[run << 4 | size])
            put(v if v > 0 else v + (1 << size) - 1, size)
            run = 0
        if run:
            pending += 1
    flush()
    first_data = done()
    put, done = _bit_writer()
    for b in blocks:
        old = [shrink(v) for v in b]
        late = [k for k in range(1, 64) if old[k] == 0 and abs(b[k]) == 1]
        k = 1
        while True:
            target = next((x for x in late if x >= k), None)
            zeros, fixes, j = 0, [], k
            stop = 64 if target is None else target
            while j < stop and not (zeros == 15 and old[j] == 0 and target is not None):
                if old[j]:
                    fixes.append(abs(int(b[j])) & 1)
                else:
                    zeros += 1
                j += 1
            if target is None:
                put(*ac_codes[0x00])
                for bit in fixes:
                    put(bit, 1)
                break
            if j < target:
                put(*ac_codes[0xF0])
                for bit in fixes:
                    put(bit, 1)
                k = j + 1
                continue
            put(*ac_codes[zeros << 4 | 1])
            put(int(b[target] > 0), 1)
            for bit in fixes:
                put(bit, 1)
            k = target + 1
            if k > 63:
                break
    refine_data = done()
    mark = jpeg._marker
    scan = lambda ss, se, a, data: mark(0xDA, bytes([1, 1, 0, ss, se, a])) + data
    file = (
        b"\xff\xd8" + mark(0xDB, bytes([0] + [1] * 64)) + mark(0xC2, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0])) + mark(0xC4, jpeg._dht(0, dc) + jpeg._dht(0x10, ac))
        + scan(0, 0, 0, dc_data) + scan(1, 63, 1, first_data) + scan(1, 63, 0x10, refine_data) + b"\xff\xd9"
    )
    images, got = jpeg.coefficients_of([file, file])
    assert (got == np.concatenate([blocks, blocks])).all()
    assert jpeg.tensors(images, got)[0].shape == (16, 24, 3)


@pytest.mark.parametrize("interval", [0, 2])
def test_jpeg_decoder_takes_first_coefficients_of_several_components(interval):
    """A 4:2:0 image whose size isn't a multiple of a unit, in a joint first scan and a joint refinement, with restarts."""
    rng, width, height = np.random.default_rng(3), 37, 21
    across, down = 3, 2
    planes = {1: rng.integers(-200, 200, (4, 6)), 2: rng.integers(-200, 200, (2, 3)), 3: rng.integers(-200, 200, (2, 3))}
    dc = {4: list(range(12))}
    codes = jpeg.canonical(dc)

    def scan(refine):
        put, done = _bit_writer()
        parts, last = [], {1: 0, 2: 0, 3: 0}
        for unit in range(across * down):
            if interval and unit and unit % interval == 0:
                parts.append(done())
                put, done = _bit_writer()
                last = {1: 0, 2: 0, 3: 0}
            y, x = divmod(unit, across)
            blocks = [(1, planes[1][2 * y + j, 2 * x + i]) for j in (0, 1) for i in (0, 1)] + [(c, planes[c][y, x]) for c in (2, 3)]
            for c, value in blocks:
                if refine:
                    put(int(value) & 1, 1)
                    continue
                diff, last[c] = (int(value) >> 1) - last[c], int(value) >> 1
                size = abs(diff).bit_length()
                put(*codes[size])
                put(diff if diff >= 0 else diff + (1 << size) - 1, size)
        parts.append(done())
        return parts[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))

    mark = jpeg._marker
    frame = bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = lambda a: mark(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, a]))
    file = b"\xff\xd8" + mark(0xDB, bytes([0] + [1] * 64)) + mark(0xC2, frame) + mark(0xC4, jpeg._dht(0, dc)) + (mark(0xDD, bytes([0, interval])) if interval else b"")
    file += head(1) + scan(False) + head(0x10) + scan(True) + b"\xff\xd9"
    images, got = jpeg.coefficients_of([file, file])
    for image in images:
        assert image.shape == [(3, 5), (2, 3), (2, 3)]
        for (rows, columns), first, plane in zip(image.shape, image.first_block, planes.values()):
            assert (got[first : first + rows * columns, 0].reshape(rows, columns) == plane[:rows, :columns]).all()
        assert jpeg.payload_of(image, got) is None
    assert jpeg.tensors(images, got)[1].shape == (height, width, 3)


def test_media_round_trip(spark):
    texts = [None, "", "x" * 193, "é中" * 500, "plain text", "plain text", "y" * 100_000]
    docs = spark.createDataFrame([(i, t, b"1") for i, t in enumerate(texts)], "doc_id long, text string, feature binary")
    got = {r.doc_id: r for r in media.round_trip_digests(docs).collect()}
    for i, t in enumerate(texts):
        data = media.padded(t or "")
        assert len(data) % 192 == 0 and data.rstrip(b" ") == (t or "").encode()
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].tail_crc32) == (len((t or "").encode()), len(data), zlib.crc32(data[-16:]))
    assert got[4][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    kept = media.store(docs)
    back = {r.doc_id: r for r in media.read(kept).collect()}
    assert [bytes(back[i].payload) for i in range(len(texts))] == [media.padded(t or "") for t in texts]
    assert {i: r.feature for i, r in back.items()} == {i: r.feature for i, r in got.items()}
    for i, t in enumerate(texts):
        file = bytes(kept.filter(F.col("doc_id") == i).first().media)
        assert file == jpeg.encode([media.padded(t or "")])[0]
        assert (got[i].payload_sha256, got[i].media_sha256, got[i].media_bytes) == (hashlib.sha256(media.padded(t or "")).hexdigest(), hashlib.sha256(file).hexdigest(), len(file))
        samples = np.frombuffer(bytes(back[i].tensor), np.uint8).reshape(back[i].height, back[i].width, 3).astype(int)
        sums = [sum(map(int, samples[:, :, c].sum(1))) for c in range(3)]
        assert back[i].feature == f"{back[i].width}x{back[i].height}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(bytes(back[i].tensor)):08x}"
    odd = kept.select("doc_id", F.when(F.col("doc_id") != 2, F.col("media")).alias("media"), F.lit(1).alias("tensor"))
    assert {r.doc_id for r in media.read(odd).filter("payload IS NULL AND tensor IS NULL").collect()} == {2}
    assert media.round_trip_digests(docs.limit(0)).count() == 0


def test_chat_rotation_matches_sql(spark):
    rows = [(1, 0, "ann", "hi", 1), (1, 1, "bob", "<|im_end|> é", 2), (1, 1, "bob", "again", 3), (1, 70, "ann", None, 4), (1, 0, "system", "s", 5), (2, 0, "system", "alone", 6)]
    rows += [(None, 0, "x y\n", "a", 7), (None, None, None, "b", 8), (1, 0, "ann", "hi", 9), (3, 2, "zoë", "", 10)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask long")
    got = same(chat_format.rotation_digests(turns), queries.OP6_SQL, conversations=turns)
    assert len(got) == 2 + 2 + 1
    shown = chat_format.rotate(turns).filter("conv_id = 1 and perspective = 'bob'").first()
    assert [shown.rendered[s.start : s.end] for s in shown.mask] == ["<| im_end|> é<|im_end|>", "again<|im_end|>"] or len(shown.mask) == 2
    assert "user name=ann" in shown.rendered and "assistant" in shown.rendered and shown.rendered.count("<|im_start|>system") == 1
    assert chat_format.rotation_digests(turns.limit(0)).count() == 0


def test_whole_dialogues_are_rendered_with_repeats_and_distinct_names(spark):
    random_ = random.Random(3)
    rows = [(i % 3, i // 3, random_.choice(["ann", "a b", "a_b", "_612062", None, "_null", "system", "unknown"]), random_.choice(["yes", "no"]) + " x" * (i % 5)) for i in range(600)]
    rows += rows[:50]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(chat_format.rotation_digests(turns), queries.OP6_SQL, conversations=turns)
    whole = {(r.conv_id, r.perspective): r for r in chat_format.rotate(turns).collect()}
    name = lambda r: "_null" if r is None else r if r.replace("_", "").isalnum() and r[0] != "_" else "_" + r.encode().hex()
    for conv in range(3):
        told = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3]))
        for who in {r[2] for r in told} - {"system"}:
            heads = ["system" if r[2] == "system" else "assistant" if r[2] == who else "user name=" + name(r[2]) for r in told]
            got = whole.pop((conv, who))
            assert got.rendered == "".join(f"<|im_start|>{h}\n{r[3]}<|im_end|>\n" for h, r in zip(heads, told)) and got.n_messages == len(told)
            assert [got.rendered[s.start : s.end] for s in got.mask] == [r[3] + "<|im_end|>" for r in told if r[2] == who]
            others = {h for h in heads if h.startswith("user")}
            assert len(others) == len({r[2] for r in told} - {"system", who})
    assert not whole


def test_long_dialogues_are_one_rendering_in_linear_time(spark, monkeypatch):
    def told(n):
        return spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("role"), F.lit("short one").alias("text"))

    took = {}
    for n in (2_000, 60_000):
        began = time.perf_counter()
        rows = chat_format.rotate(told(n)).collect()
        took[n] = time.perf_counter() - began
        assert len(rows) == 2 and {r.n_messages for r in rows} == {n}
        for r in rows:
            assert len(r.mask) == n // 2 and all(r.rendered[s.start : s.end] == "short one<|im_end|>" for s in r.mask)
    assert took[60_000] < took[2_000] + 20
    small = told(300)
    want = rows_of_rotation(chat_format.rotate(small))
    monkeypatch.setattr(chat_format.running, "__defaults__", (None, 50))
    assert rows_of_rotation(chat_format.rotate(small)) == want


def rows_of_rotation(df):
    return sorted((r.perspective, r.rendered, [tuple(s) for s in r.mask]) for r in df.collect())


def mix_docs(spark, n=400, seed=1):
    random_ = random.Random(seed)
    rows = []
    for i in range(n):
        source = random_.choice(["src0"] * 5 + ["src1", "src2", "src3", None, "x"])
        words = " ".join(random_.choices(["a", "bb", "c\n", "\t"], k=random_.randint(0, 30)))
        rows.append((i, random_.choice([words, words, words, None, ""]), random_.choice(["en", "de", None]), source, 5, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string")


@pytest.mark.parametrize("mixture", [queries.MIXTURE, mixing.Mixture(budget_parts=3, max_epochs=3), mixing.Mixture({"domain": {"web": 0, "other": 7}}, 1, 7, 1)])
def test_mixing_matches_sql(spark, mixture):
    docs = mix_docs(spark)
    domain = mixing.domain_of_source(F.col("source"))
    sql = queries.mixture_sql(mixture).replace("FROM leaves GROUP BY domain", "FROM leaves WHERE (CASE domain WHEN 'web' THEN %d ELSE 1 END) > 0 GROUP BY domain" % mixture.weights.get("domain", {}).get("web", 1), 1)
    if mixture.weights.get("domain", {}).get("web") == 0:
        got = [tuple(r) for r in mixing.mixture_rows(docs, mixture, domain).collect()]
        assert got and all(r[1] != "web" for r in got)
        return
    got = same(mixing.mixture_rows(docs, mixture, domain), sql, documents=docs.select("doc_id", "text", "lang", "source"))
    total = sum(len([w for w in (r.text or "").split() if w]) for r in docs.collect())
    taken = {}
    for _, dom, *_, n in got:
        taken[dom] = taken.get(dom, 0) + n
    assert sum(taken.values()) <= total * mixture.budget_parts // mixture.budget_whole


def test_mixed_documents_cut_texts_to_words(spark):
    docs = mix_docs(spark)
    out = mixing.mixed_documents(docs, queries.MIXTURE, mixing.domain_of_source(F.col("source")))
    assert out.columns == docs.columns
    want = sum(r[-1] for r in mixing.mixture_rows(docs, queries.MIXTURE, mixing.domain_of_source(F.col("source"))).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert sum(len((r.text or "").split()) for r in rows) == want
    assert all((texts[r.doc_id] or "").startswith(r.text or "") for r in rows)
    assert mixing.mixed_documents(docs.limit(0), queries.MIXTURE, mixing.domain_of_source(F.col("source"))).count() == 0


def test_mixing_refines_the_bucket_of_the_end(spark, monkeypatch):
    docs, domain = mix_docs(spark, 3000, 5), mixing.domain_of_source(F.col("source"))
    rows = lambda: sorted(mixing.mixture_rows(docs, queries.MIXTURE, domain).collect(), key=repr)
    want = rows()
    same(mixing.mixture_rows(docs, queries.MIXTURE, domain), queries.OP2_SQL, documents=docs.select("doc_id", "text", "lang", "source"))
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    assert rows() == want
    plan = mixing.plan_mixture(mixing.sizes(docs, domain), queries.MIXTURE).filter("cut IS NOT NULL")
    assert plan.count() and max(len(r.cut) for r in plan.collect()) > 2


def test_budgets_of_very_many_tokens(spark):
    rows = [("web", "en", f"s{i}", 3 * 10**13 + i) for i in range(31)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    mixture = mixing.Mixture({"source": {f"s{i}": 10_000 - i for i in range(31)}}, 1, 2, 2)
    given = {r.source: r.given for r in mixing.leaf_budgets(leaves, mixture).collect()}
    total = sum(r[3] for r in rows) // 2
    weights = sum(10_000 - i for i in range(31))
    assert sum(given.values()) == total
    assert all(abs(given[f"s{i}"] - total * (10_000 - i) / weights) <= 1 for i in range(31))


def toxic_corpus(n=900, seed=9):
    random_ = random.Random(seed)
    plain = ["w" + "".join(random_.choices("abcdefghij", k=4)) for _ in range(300)]
    bad = ["vilest", "vilify", "grotty", "nasty"]
    rows = []
    for i in range(n):
        sentences = [" ".join(random_.choices(plain, k=random_.randint(4, 9))) for _ in range(random_.randint(1, 12))]
        y = int(random_.random() < 0.3)
        if y:
            at = random_.randrange(len(sentences))
            sentences[at] += " " + random_.choice(bad) + " " + random_.choice(bad)
        rows.append((i, ". ".join(sentences), y))
    return rows


def test_toxicity_held_out_accuracy_and_places(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert len(got) == len(rows) + 2
    held = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for _, r in held) and len(held) == sum(r.held_out for i, r in got.items() if i < 5000)
    assert sum(y == r.predicted for y, r in held) / len(held) > 0.95
    assert got[5000].score == got[5001].score == 0.0
    texts = {i: t for i, t, _ in rows}
    found = [texts[i][s.start : s.end] for i, r in got.items() for s in r.offending if i < 5000]
    assert found and sum(any(w in f for w in ("vil", "grotty", "nasty")) for f in found) / len(found) > 0.95
    clean = {r.doc_id for r in toxicity.clean_documents(docs, model).collect()}
    assert clean == {i for i, r in got.items() if not r.predicted}
    none = toxicity.scores(docs, toxicity.train(docs, labels.limit(0))).agg({"score": "max"}).first()
    assert none[0] == 0.0


def test_toxicity_scores_are_the_noisy_or_of_every_sentence(spark):
    bias, weights = toxicity.fit([t for _, t, _ in toxic_corpus(300)], [y for _, _, y in toxic_corpus(300)])
    random_ = random.Random(8)
    words = ["vil", "grotty", "Nasty", "nastier", "good", "tree", "İx", "ΑΣ", "new", *weights][:40]
    texts = [". ".join(" ".join(random_.choices(words, k=random_.randint(0, 6))) for _ in range(random_.choice([1, 3, 40, 400]))) for _ in range(60)]
    texts += ["the tree is new. " * 3000, "", " ", "12. 3!"]

    def brute(text):
        sentences, now = [], ""
        for c in text + ".":
            if c in ".!?\n":
                bag = {w for w in "".join(x if x.isalpha() else " " for x in now.lower()).split()}
                sentences += [bag] if bag else []
                now = ""
            else:
                now += c
        none = 1.0
        for bag in sentences:
            known = sum(weights.get(f, 0.0) for w in bag for f in [w, *[w[:n] + "*" for n in (4, 5, 6, 7) if n <= len(w)]])
            none *= 1 - 1 / (1 + math.exp(-(bias - math.log(len(sentences)) + known)))
        return 1 - none

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, (bias, weights)).collect()}
    assert all(abs(got[i] - brute(t)) < 1e-9 for i, t in enumerate(texts))
    assert got[60] < 0.1  # no more toxic for being long


def test_toxicity_ignores_held_out_labels(spark):
    rows = toxic_corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a == b
