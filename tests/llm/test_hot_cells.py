"""SimHash cells of many fingerprints, and language profiles of texts with very many different trigrams."""

import numpy as np

from voltaic.llm import langid, simhash


def crowded(rng, n):
    """Fingerprints that differ in the bits of two parts alone."""
    bits = [b for k in (0, 1) for b in simhash._PART_BITS[k]]
    patterns = rng.choice(1 << len(bits), n, replace=False).astype(np.uint64)
    fps = np.full(n, 0x5A5A << 40, np.uint64)
    for i, b in enumerate(bits):
        fps = (fps & ~np.uint64(1 << b)) | (patterns >> np.uint64(i) & np.uint64(1)) << np.uint64(b)
    return fps


def roots(fps, edges):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {f: find(f) for f in fps}


def test_coordinates_tell_all_patterns_apart():
    for parts in (simhash._PART_BITS, *simhash._OPEN_BITS):
        for k, bits in enumerate(parts):
            patterns = np.array([sum((i >> j & 1) << b for j, b in enumerate(bits)) for i in range(1 << len(bits))], np.uint64)
            assert len(np.unique(simhash._coordinates(patterns, [bits])[:, 0])) == len(patterns), k
    assert sorted(b for bits in simhash._PART_BITS for b in bits) == list(range(64))


def test_a_crowded_cell_is_dealt_once_more(spark, monkeypatch):
    rng = np.random.default_rng(7)
    fps = np.concatenate([crowded(rng, 3000), rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    near = [(i, j) for i in range(len(fps)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2)).tolist()]
    signed = fps.view(np.int64).tolist()
    want = roots(signed, [(signed[i], signed[j]) for i, j in near])
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for large in (100, 1 << 20):
        monkeypatch.setattr(simhash, "LARGE", large)
        edges = [(r.a, r.b) for r in simhash.links(df).collect()]
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
        assert roots(signed, edges) == want and len(set(want.values())) < len(fps)


def test_finer_cells_are_small():
    fps = crowded(np.random.default_rng(8), 60_000)
    choice = simhash._CHOICES.index((2, 3, 4, 5))
    cell = simhash.cell_numbers(fps)[:, choice]
    assert len(np.unique(cell)) == 1
    _, sizes = np.unique(simhash.finer_numbers(fps, cell, np.full(len(fps), choice)).ravel(), return_counts=True)
    assert sizes.max() <= 256


def test_bundles_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4F00, 900))), "abc abd", "", "zzz", "".join(map(chr, rng.integers(97, 123, 400)))]
    grams = langid.Trigrams(texts, {}, 256)
    want = grams.bundles(grams.count)
    monkeypatch.setattr(langid, "_SEGMENT", 7)
    monkeypatch.setattr(langid, "_CELLS", 14)
    assert (grams.bundles(grams.count) == want).all() and not want[2].any()
    lone = langid.Trigrams(texts[:1], {}, 256)
    assert (lone.bundles(lone.count)[0] == want[0]).all()
    by = grams.bundles(grams.count, np.float64, np.where(grams.text < 2, 0, 1), 2)
    assert (by[0] == want[:2].sum(0)).all() and (by[1] == want[2:].sum(0)).all()
