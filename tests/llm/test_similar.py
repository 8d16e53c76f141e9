"""The pipeline's near-copy stage against brute force over all pairs, and planted near copies."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from voltaic.llm import simhash, similar

SF = "/root/testdata/sf0.01"


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_near_copies_from_0_8_to_0_98_leave_one_whole_document(spark):
    rng = random.Random(8)
    rows, kinds = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")], []
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = words.copy()
        for at in rng.sample(range(10, 190, 12), 1 + g % 5):
            other[at] = "changed"
        rows += [(10 * g + 100, " ".join(words)), (10 * g + 101, " ".join(other))]
        kinds.append(jaccard(*({tuple(w[i : i + 5]) for i in range(196)} for w in (words, other))))
    want = {0, 2, 4} | {10 * g + 100 for g in range(40)} | {10 * g + 101 for g in range(40) if kinds[g] < 0.8}
    assert min(kinds) < 0.8 and sum(0.8 <= k < 0.85 for k in kinds) >= 8 and max(kinds) > 0.94
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()}
    assert got == {i: t for i, t in rows if i in want}
    assert similar.near_copies(df.limit(0)).count() == 0


def test_components_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted({r.text or "" for r in docs.select("text").collect()})
    sets = [set(similar.shingles(t.encode(), 5).tolist()) for t in texts]
    root = np.arange(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                root[root == root[i]] = root[j]
    keyed = spark.createDataFrame([(t, int(r)) for t, r in zip(texts, root, strict=True)], "text string, want long").withColumns(similar.text_keys("text"))
    rows = keyed.join(similar.near_copies(docs), ["t1", "t2"]).select("want", "component").collect()
    assert len(rows) == len(texts)
    assert len({tuple(r) for r in rows}) == len({r.want for r in rows}) == len({r.component for r in rows}) < len(texts)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(-(1 << 63), 1 << 62, k)) for k in (1, 3, 60, 64, 65, 120, 130, 500, 3000, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, len(s) // 10)])) for s in sets]
    sets = [s for s in sets if len(s)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if 0.5 < len(sets[i]) / len(sets[j]) < 2]
    rows = [(i, j, similar.bitmap(sets[i]), similar.bitmap(sets[j])) for i, j in pairs]
    assert {len(r[2]) / len(r[3]) for r in rows} == {0.5, 1, 2}
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    for i, j, n in df.select("i", "j", similar.differing(F.col("a"), F.col("b"))).collect():
        assert n <= len(np.setxor1d(sets[i], sets[j])) and (n == 0 or i != j)
        if len(sets[i]) == len(sets[j]) < 130 and i != j:
            assert n > 0


def linked(spark, texts):
    """Pairs of places whose texts are in one component."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumns(similar.text_keys("text"))
    rows = df.join(similar.near_copies(df), ["t1", "t2"]).select("k", "component").collect()
    assert len(rows) == len(texts)
    root = {r.k: r.component for r in rows}
    return {(i, j) for i in root for j in root if i < j and root[i] == root[j]}


def test_no_link_is_lost_to_fingerprints(spark):
    """Four of five shingles shared: similarity 0.8, while the fingerprints differ in 26 bits."""
    text = "w778150 w472420 w173432 w622206 w617256 w391258 w54088 w881562 w761160"
    assert linked(spark, [text, text.rsplit(" ", 1)[0], "other"]) == {(0, 1)}


def test_one_large_cell(spark, monkeypatch):
    """Texts of one template, most just under the similarity and some over it, meet in the same cells, in several rounds."""
    monkeypatch.setattr(similar, "MEET", 2)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(120):
        words = base.copy()
        for at in rng.sample(range(60), 1 + k % 3):
            words[at] = f"x{rng.randrange(40 if k % 2 else 10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    assert 1 < len(set(root)) < 120
    assert linked(spark, texts) == {(i, j) for i in range(120) for j in range(120) if i < j and root[i] == root[j]}


def test_pivots_link_most_near_copies_before_the_exact_search(spark, monkeypatch):
    """F8: without the exact search's cells no near copy was linked, as SimHash and pivots dealt no pair."""
    rng = random.Random(5)
    texts, want = [], set()
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = words.copy()
        for at in rng.sample(range(10, 190, 12), 1 + g % 4):
            other[at] = "changed"
        want.add((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    nothing = spark.createDataFrame([], "h long, node long, n int, rest int")
    monkeypatch.setattr(similar, "_cells", lambda *_: nothing)
    monkeypatch.setattr(similar, "drop_cut", lambda *_: None)
    got = linked(spark, [*texts, texts[0].upper(), "one two", "two one", ""])
    assert (0, len(texts)) in got and got <= want | {(0, len(texts)), (1, len(texts))} and len(got & want) >= 57


def test_near_links_are_those_of_all_pairs(spark, monkeypatch):
    """All within 4 bits are linked, nothing beyond the radius, and a crowded cell in parts stays connected."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flip = lambda f, k: f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fps = np.unique(np.array([f for b in base for f in (b, *(flip(b, k) for k in (1, 4, 7, 14)))] + [flip(base[0], 2) for _ in range(200)], np.uint64))
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for crowd in (1 << 12, 40):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        edges = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long")).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.RADIUS for a, b in edges)
        root = {f: f for f in fps.view(np.int64).tolist()}
        for a, b in edges:
            if root[a] != root[b]:
                root = {f: root[a] if r == root[b] else r for f, r in root.items()}
        signed = fps.view(np.int64).tolist()
        near = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(apart <= 4), strict=True) if i < j]
        assert len(near) > 1000 and all(root[a] == root[b] for a, b in near)


def test_cells_give_forests():
    """F1 of round 3's findings: a cell of up to 64 fingerprints gave all of its near pairs, here 435 of 30."""
    rng = np.random.default_rng(6)
    near = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)))[:30]
    apart = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    for fps in (near, np.concatenate([near, apart]), np.concatenate([apart[:2], near[:3]]), near[:0]):
        a, b = simhash.cell_links(fps, np.array([len(fps)] * bool(len(fps)), np.int64), simhash.RADIUS)
        pairs = {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        held = len(np.intersect1d(fps, near))
        assert len(pairs) == max(0, held - 1) and {x for p in pairs for x in p} <= set(near.tolist())


def test_texts_of_the_same_words_in_other_orders_make_no_pairs(spark):
    """F1 of round 3's findings: fingerprints of words alone brought them together, though no shingle is shared."""
    rng = random.Random(2)
    words, texts = [f"w{k}" for k in range(120)], []
    for k in range(60):
        rng.shuffle(words)
        texts.append(" ".join([*words, f"x{k}", f"y{k}"]))
    texts.append(f"{texts[0]} z")
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns(similar.text_keys("text"))
    nodes = similar._described(df, 5).cache()
    single = nodes.dropDuplicates(["fp"])
    assert simhash.near_links(single.select("fp")).count() > 10
    assert similar._near(single).count() <= 1


def test_shingles_of_one_set_are_never_written(spark, monkeypatch):
    """F1 of round 3's findings: all first shingles were written and dealt again twice, which took the disk."""
    written, cut = [], similar.cut

    def counted(df, name):
        out = cut(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(similar, "cut", counted)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, f"{texts[0]} more"]], "text string").withColumns(similar.text_keys("text"))
    cells = similar._cells(df.repartition(4), 5, 0.8)
    assert sum(n for _, n in written) == 2 == cells.select("node").distinct().count()
