"""The corpus operators against brute force, round trips and libraries, and their edge cases."""

import collections
import hashlib
import random
import zlib

import ahocorasick
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voltaic.llm import components, langid, mixing, packing, quality, queries, simhash, substrings, tokens, topk, webp

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "A.", "ab\tc\n d\x0be\r\x0c", "é ü 日本語 😀", "x" * 5000, "no yes " * 900, "<|endoftext|> <|startoftext|>", "\x1c\x1d a b", "a", "a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, None if i % 3 else "s", "extra", 1.0) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- media


def image(rng, w, h, colours=None):
    p = rng.integers(0, 256, (w * h, 4) if colours is None else (colours, 4)).astype(np.uint8)
    p = p if colours is None else p[rng.integers(0, colours, w * h)]
    return w, h, np.ascontiguousarray(p).view(np.uint32).ravel()


@pytest.mark.parametrize("transforms", [(), (("green",),), *[(("predictor", m),) for m in range(14)], (("cross", 7, -40, 100),), (("predictor", 11), ("cross", 1, 2, 3), ("green",))])
@pytest.mark.parametrize("cache_bits", [0, 1, 8])
def test_webp_round_trip(transforms, cache_bits):
    rng = np.random.default_rng(3)
    images = [image(rng, 7, 5), image(rng, 1, 1), image(rng, 30, 20, 3), image(rng, 144, 3, 1), image(rng, 600, 3, 9)]
    for (w, h, p), got in zip(images, webp.decode(webp.encode(images, transforms, cache_bits)), strict=True):
        assert got[:2] == (w, h) and (got[2] == p).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 17, 256])
def test_webp_palettes(colours):
    w, h, p = image(np.random.default_rng(colours), 33, 9, colours)
    got = webp.decode(webp.encode([(w, h, p)], (("palette",),)))[0]
    assert (got[2] == p).all()


def test_webp_meta_prefix_codes_and_bad_files():
    """A stream written by hand: 8 x 1 pixels, two groups of prefix codes chosen by an entropy image."""
    bits = []
    put = lambda v, n: bits.extend((v >> i) & 1 for i in range(n))
    lone = lambda s: (put(1, 1), put(0, 1), put(1, 1), put(s, 8))  # noqa: E731  a prefix code of one symbol
    for v, n in ((0x2F, 8), (8 - 1, 14), (1 - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        put(v, n)
    put(0, 1)  # the entropy image, 2 x 1: no colour cache
    put(1, 1), put(1, 1), put(1, 1), put(0, 8), put(1, 8)  # green 0 or 1 is the group
    for s in (0, 0, 0):
        lone(s)
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)
    put(0, 1), put(1, 1)
    for green in (10, 20):
        for s in (green, 1, 2, 255):
            lone(s)
        put(1, 1), put(0, 1), put(0, 1), put(0, 1)
    data = bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    file = b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
    w, h, p = webp.decode([file])[0]
    assert (w, h) == (8, 1) and p.tolist() == [0xFF010A02] * 4 + [0xFF011402] * 4
    assert webp.decode([b"", b"junk", file[:24]]) == [None, None, None]


def test_media_query(spark, docs, odd, none):
    rows = {r.doc_id: r for r in queries.media_columns(spark, SF).collect()}
    for d in docs.collect():
        payload = webp.pad(d.text.encode())
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(d.text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    got = webp.read_payloads(webp.store_payloads(odd)).collect()
    assert sorted(bytes(r.pixels) for r in got) == sorted(webp.pad((t or "").encode()) for t in ODD)
    assert webp.read_payloads(webp.store_payloads(none)).count() == 0
    long = bytes(range(256)) * 3000
    assert webp.decode_payloads(webp.encode_payloads([webp.pad(long)]))[0][0] == webp.pad(long)


def first_transform(file: bytes) -> int | None:
    """0 predictor, 1 cross-colour, 2 green, 3 palette: bits 1 and 2 after the 40 of the header."""
    return (file[25] >> 1) & 3 if file[25] & 1 else None


def test_the_query_chooses_among_transforms(spark):
    """Texts for which each transform pays are stored with it, and come back whole; prose takes none."""
    rng = np.random.default_rng(8)
    n = 144 * 6
    walk = 80 + np.clip(np.cumsum(rng.integers(-1, 2, (n, 4)), axis=0), -40, 40)
    grey = np.repeat(rng.integers(48, 122, (n, 1)), 4, axis=1)
    half = rng.integers(64, 126, (n, 4))
    half[:, 0] = 32 + ((16 * half[:, 1]) >> 5)  # red follows green
    few = rng.integers(65, 67, (n // 6, 4))
    texts = {0: walk, 2: grey, 1: half, 3: np.repeat(few[:, :1], 4, axis=1)}
    rows = [(k, bytes(v.astype(np.uint8).ravel()).decode()) for k, v in texts.items()] + [(9, "".join(rng.choice(list("abcdefghij klmnop"), 3000)))]
    stored = webp.store_payloads(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in webp.read_payloads(stored).collect()}
    for k, text in rows:
        assert bytes(got[k].pixels) == webp.pad(text.encode())
        assert first_transform(bytes(got[k].media)) == (k if k < 9 else None)


# ---- tokens and packing


def test_token_counts(spark, docs, odd, none):
    library = Tokenizer.from_file(queries.COUNTING)
    for df in (docs, odd):
        texts = [r.text or "" for r in df.collect()]
        want = sorted((len(t.encode()), len(e.ids)) for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))
        got = tokens.count_tokens(df, queries.COUNTING, public_tokenizers.PATTERN).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(none, queries.COUNTING, public_tokenizers.PATTERN).count() == 0


def test_random_texts_tokenize_alike():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n'sé<|>endoftext\t  ") for _ in range(60)) for _ in range(500)]
    library = Tokenizer.from_file(queries.COUNTING)
    assert tokens.TokenCounter(queries.COUNTING, public_tokenizers.PATTERN).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    words = Tokenizer.from_file(queries.PACKING)
    assert packing.WordIds(queries.PACKING).ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in words.encode_batch(texts, add_special_tokens=False)]


def test_patterns_that_join_across_blanks():
    """A pattern whose pre-tokens cross blanks is applied to whole texts."""
    counter = tokens.TokenCounter(queries.COUNTING, r"[a-z]+ [a-z]+|\s|\S")
    assert not counter.by_word and tokens.TokenCounter(queries.COUNTING, public_tokenizers.PATTERN).by_word
    text = "ab cd ef"
    assert counter.counts([text]) == [sum(counter._tokens([[p]])[0] for p in counter.split(text))]


def check_packing(rows):
    by = collections.defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= 2048
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing(spark, docs, odd, none):
    library = Tokenizer.from_file(queries.PACKING)
    rows = packing.pack_documents(docs, queries.PACKING, group_items=50).collect()
    used, total = check_packing(rows), sum(r.length for r in rows)
    assert used <= -(-total // 2048) + 3
    pieces = {(r.doc_id, r.piece): r for r in rows}
    for d in docs.collect():
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        for i in range(-(-len(ids) // 2048)):
            part = ids[i * 2048 : (i + 1) * 2048]
            r = pieces.pop((d.doc_id, i))
            assert (r.start, r.length, r.ids_crc32) == (i * 2048, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    check_packing(packing.pack_documents(odd, queries.PACKING).collect())
    assert packing.pack_documents(none, queries.PACKING).count() == 0


# ---- mixing and search


def test_mixing(spark, odd, none):
    rows = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    assert abs(sum(v[0].target for v in by.values()) - sum(r.size for r in rows)) < 1e-3
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 0.02 * v[0].target
    again = mixing.mix_sources(odd).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix_sources(odd).collect()))
    assert len(again) == len(ODD) and all(r.taken <= 3 * r.size for r in again)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_repeated_rows_and_long_texts(spark):
    """Each source comes within one small document of its target, however often rows repeat and wherever long ones rank."""
    rows = [(i % 4, "a", "w " * (3 + i % 4)) for i in range(160)] + [(100 + i, "b", "w " * (400 if i % 50 == 0 else 5)) for i in range(300)]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows + rows[-9:])], "doc_id long, source string, text string, nr long, size string")
    got = mixing.mix_sources(df, keep=("nr",)).collect()
    assert sorted(r.nr for r in got) == list(range(len(rows) + 9))
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and all(r.taken == r.copies * r.size <= 3 * r.size for r in own)
    seeds = [{r.doc_id: r.copies for r in mixing.mix_sources(df, seed=s).collect() if r.source == "b"} for s in range(4)]
    long, short = (np.mean([[d[100 + i] for i in range(300) if (i % 50 == 0) == big] for d in seeds]) for big in (True, False))
    assert long > short  # inclusion differs by size


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["c"] == 3.0 and got["b"] <= 30 and got[None] <= 15 and sum(got.values()) == pytest.approx(116)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)] + [(50, None), (150, [float("nan")] * 6), (151, [None] * 6), (None, [1.0] * 6), (152, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    df = df.union(df.filter("vec_id in (0, 3)")).union(spark.createDataFrame([(7, [0.5] * 6)], df.schema))
    vectors += [v for v in vectors if v[0] in (0, 3)] + [(7, [0.5] * 6)]
    got = topk.top_k(df, query_rows=2, candidate_rows=16).collect()
    clean = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v))) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for k, (q, v) in enumerate(clean):
        ranked = sorted((-int(np.dot(v, w)), c) for j, (c, w) in enumerate(clean) if j != k) if q % 50 == 0 else []
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(ranked[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e16, 1e16]), (1, [1e16, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(huge).first().score == (1 << 63) - 1


# ---- near duplicates and passages


def test_simhash(spark, docs, odd, none):
    rows = simhash.near_duplicates(docs).collect()
    fps = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    ids = np.array([r.doc_id for r in rows])
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    labels = ids.copy()
    while (new := np.array([labels[k].min() for k in linked])).tolist() != labels.tolist():
        labels = new
    assert labels.tolist() == [r.component_id for r in rows]
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.fingerprint for r in got if r.component_id == 1} == {"0" * 16}
    assert simhash.near_duplicates(none).count() == 0


def roots(n, i, j):
    """The least index linked with each of n."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            return root.tolist()
        root = new


@pytest.mark.parametrize(("n", "free"), [(200, 64), (6000, 18), (3000, 12), (40, 3)])
def test_cells_link_all_within_two_bits(n, free):
    """Fingerprints that differ in few bits share cells, over 2,048 of them too; what links is what all pairs link."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, dtype=np.uint64)
    noise = rng.integers(0, 1 << (free - 1), n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    flips = [noise ^ (np.uint64(1) << rng.integers(0, free, n, dtype=np.uint64)) for _ in range(2)]
    fps = np.unique(base ^ np.concatenate([noise, *flips])[:n])
    cells = simhash.cell_numbers(fps)
    order = np.argsort(cells.ravel(), kind="stable")
    _, sizes = np.unique(cells.ravel(), return_counts=True)
    assert free >= 64 or free < 10 or sizes.max() > 2048
    a, b = simhash.cell_links(np.repeat(fps, cells.shape[1])[order], sizes)
    got = roots(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert got == roots(len(fps), x, y)
    assert (np.bitwise_count(a ^ b) <= 2).all()


def test_pivots_discard_none_that_link():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64))
    table, n = simhash.pivot_table(np.concatenate([a, b])), np.arange(4000)
    assert len(simhash._survive(table, n, n + 4000)[0]) == 4000 and len(simhash._survive(table, n, np.roll(n, 1))[0]) < 5
    assert (simhash.cell_numbers(a) == simhash.cell_numbers(b)).any(1).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def kept_by_brute_force(rows):
    counts, words = collections.Counter(), [(t or "").encode().split() for _, t in rows]
    for w in words:
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            gone[i : i + 35] |= counts[tuple(w[i : i + 35])] > 1
        out.append((len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substrings(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = " ".join(map(str, range(100)))
    rows += [(None, None), (1, ""), (2, "buy now " * 60), (3, "x " * 34), (4, "y " * 35), (5, "z " * 36), (5, "z " * 36), (6, base), (7, "a\tb\n" + " ".join(map(str, range(20, 90))) + "\x0bq")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, t1 string")
    got = substrings.dedup_substrings(df, block_bytes=50_000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(i), *k) for (i, _), k in zip(rows, kept_by_brute_force(rows), strict=True))
    assert substrings.dedup_substrings(none).count() == 0


def test_the_automata_locate(spark, docs, monkeypatch):
    """Without their phrases nothing is located; a shard finds phrases in texts that it was not built from."""
    removed = lambda: substrings.dedup_substrings(docs, block_bytes=50_000).filter("n_removed > 0 and n_removed < n_words").count()
    assert removed() > 0
    with monkeypatch.context() as m:
        m.setattr(substrings, "automaton", lambda phrases: ahocorasick.Automaton())
        assert removed() == 0
    words = lambda n: [f"w{i * i % 97}" for i in range(n)]
    one, other = (substrings.Words([" ".join(x).encode()]) for x in (words(60), [*"ab", *words(50), *"cd"]))
    shard = substrings.automaton(one.phrase_words(one.phrases)[1])
    assert set(range(2, 18)) <= set(other.located(shard).tolist()) and not len(other.located(substrings.automaton([])))


# ---- classifiers


def test_language(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.fit(d)
    pred = {r.text: r.lang_pred for r in langid.predict(odd.withColumn("doc_id", F.col("text")), model).withColumnRenamed("doc_id", "text").collect()}
    assert pred[None] == pred[""] == pred[" "] == "und" and pred["a"] != "und"
    nothing = langid.fit(none.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    got = queries.quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r.expected_grade for r in got if r.quality == 1], [r.expected_grade for r in got if r.quality == 0]
    assert np.mean([r.selected for r in got if r.quality == 1]) > 0.97 and np.mean(good) > np.mean(bad) + 0.7
    model = quality.fit(none, spark.createDataFrame([], "doc_id long, grade int"), 4)
    assert (np.diff(model.thresholds) > 0).all() and quality.rate(odd, model, 2).count() == len(ODD) and quality.rate(none, model, 2).count() == 0


# ---- pipeline


CLASHES = "n_words size copies copy t1 t2 tox_score n_removed kept_text row component lead x key".split()


def test_pipeline(spark, docs):
    """Every stage keeps the columns, whatever their names, and works on what the last one kept."""
    frame = docs.withColumns({c: F.lit(i) if i % 2 else F.lit(None).cast("string") for i, c in enumerate(CLASHES)})
    columns, sizes = frame.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, SF).toArrow()) if name != "mix_sources" else stage(spark, frame, SF)
        assert frame.columns == columns, name
        sizes.append(frame.count())
        assert all(r.size == 1 and r.copy == 3 and r.n_words is None for r in frame.select("size", "copy", "n_words").collect())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and rows


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Null ids, repeated ids with different texts, repeated rows, nulls and empties, no rows."""
    text = lambda seed: " ".join(f"w{(seed * 31 + i * i) % 1000}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(1)), (None, text(3)), (2, text(3)), (3, None), (4, ""), (5, "a b"), (5, "a b")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t in rows for s in ["s"]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", text(1)), ("1", text(2)), ("2", text(3)), ("3", ""), ("5", "a b")])
    own = corpus_pipeline.drop_repeated_passages(spark, df, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in own if r.text) == sorted([("1", text(2)), ("5", "a b"), ("5", "a b")])
    mixed = corpus_pipeline.mix(spark, df, SF)
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(len((t or "").split()) for _, t in rows)  # one source: its target is its size
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, df.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["op2_mix_sources", "op5_exact_top_k"])
def test_sql(spark, name):
    from compare import connect, difference

    assert difference(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), queries.ORACLE_SQL[name]) is None
