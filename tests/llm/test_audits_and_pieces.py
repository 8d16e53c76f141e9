"""The filter audit, SentencePiece coding and the source divergence audit: SQL, brute force, the library, edge cases."""

import hashlib
import itertools
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from voltaic.llm import divergence, filter_audit, pieces, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "A.", "ab\tc\n d\x0be\r\x0c", "é Ü 日本語 😀", "x" * 5000, "no yes " * 900, " " * 3000, "<s>▁</s> <0x41>", "\x00\x1c\x1d a b", "a", "a", "SHOUT #1", "Straße İstanbul"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, "l" if i % 4 else None, None if i % 3 else "s", "extra", 1, [1]) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part string, bits int, ids array<int>")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 1), (8, 1, 1), (None, 1, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_source_divergence"])
def test_queries_are_what_sql_gives(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) is None


# ---- filter audit


def fails_of(rows):
    """Letters of the filters that each (doc_id, text) fails, by definition."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals, signs = re.findall("[A-Z]", text), re.search(r"[#$%&*|]", text)
        again = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t in rows)
        out.append({c for c, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(capitals) > 2 * len(text), signs, again), strict=True) if bad})
    return out


def test_audit_of_odd_rows(odd, labels):
    rows = [(r.doc_id, r.text, r.source or "") for r in odd.collect()]
    fails, good, toxic = fails_of([r[:2] for r in rows]), {1, 8}, {1, 8}
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit_filters(odd, labels).collect()}
    assert len(got) == 2 * 120 * 5
    for part in ("", "s"):
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if r[2] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                r = got[part, order, step]
                assert (r.kept, r.removed, r.redundant) == (len(stay), len(gone), sum(x in f for _, f in own) - len(gone))
                assert (r.good_lost, r.toxic_lost, r.unique_fails) == (sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), sum(f == {x} for _, f in own))
                left = stay
        assert all(r.shapley == shapley[r.filter_order[r.step - 1]] for r in got.values() if r.part == part)
    assert filter_audit.audit_filters(odd.limit(0), labels).count() == 0
    assert filter_audit.audit_filters(odd, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_bitmaps_by_part():
    rng = np.random.default_rng(3)
    parts, bits, good, toxic = rng.integers(0, 7, 1000) * 3, rng.integers(0, 32, 1000), rng.integers(0, 2, 1000), rng.integers(0, 2, 1000)
    names, counts = filter_audit.subset_counts(parts, bits, good, toxic)
    for i, p in enumerate(names.tolist()):
        for s in range(32):
            through = (parts == p) & (bits & s == 0)
            assert counts[i, s].tolist() == [through.sum(), (through & (good == 1)).sum(), (through & (toxic == 1)).sum()]
    names, counts = filter_audit.subset_counts(*(np.zeros(0, np.int64),) * 4)
    assert len(names) == len(counts) == 0


# ---- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def test_ids_and_texts_are_the_librarys(library):
    rng, own = random.Random(5), pieces.Pieces(queries.PIECES)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aeinorst hg  ▁\n.,'éüß日本😀\r;){}/*0_") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("inghto the") for _ in range(rng.randrange(200))) for _ in range(3000)] + [" " * k + "x" for k in range(70)]
    texts += ["".join(rng.choice("inghtoesra") for _ in range(20_000)), "ng" * 3000, "a" * 100_000]
    want = library.encode(texts)
    assert own.encode(texts) == want == own.encode(texts)
    assert [own.decode(w) for w in want] == library.decode(want)
    ids = [[rng.randrange(300 if k % 2 else 32_000) for _ in range(rng.randrange(12))] for k in range(5000)]
    assert [own.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_the_memory_of_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE", 3)
    own = pieces.Pieces(queries.PIECES)
    for text in ("one two three four", "five six one", "two " * 50 + "seven"):
        assert own.encode([text])[0] == library.encode(text)
    assert len(own.words) < 12


def test_long_words_are_finished_by_a_queue(library, monkeypatch):
    monkeypatch.setattr(pieces, "_LONG", 4)
    rng, own = random.Random(6), pieces.Pieces(queries.PIECES)
    texts = ["".join(rng.choice("inghto e") for _ in range(rng.randrange(120))) for _ in range(2000)] + [" " * k for k in range(60)]
    assert own.encode(texts) == library.encode(texts)


def test_pieces_query(spark, odd, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    coded = pieces.encode(odd, queries.PIECES, decoded=True)
    assert sorted((r.ids, r.decoded) for r in coded.collect()) == sorted((library.encode(t or ""), library.decode(library.encode(t or ""))) for t in ODD)
    assert pieces.encode(odd.limit(0), queries.PIECES).count() == 0


def test_decode_of_lists(spark, library):
    lists = [None, [], [5, None, 300], [1, 29871, 29871, 2], [0]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<long>")
    got = {r.doc_id: r.text for r in pieces.decode(df, queries.PIECES).collect()}
    assert got == {k: library.decode([i for i in x or [] if i is not None]) for k, x in enumerate(lists)}
    with pytest.raises(Exception, match="ids lie between"):
        pieces.decode(spark.createDataFrame([(1, [32_000])], "doc_id long, ids array<int>"), queries.PIECES).collect()


def test_other_models_are_refused(tmp_path):
    data = open(queries.PIECES, "rb").read()
    (tmp_path / "no-fallback.model").write_bytes(data.replace(b"\x98\x02\x01", b"\x98\x02\x00"))
    with pytest.raises(ValueError, match="byte fallback"):
        pieces.Pieces(str(tmp_path / "no-fallback.model"))


# ---- divergence


def divergence_by_definition(rows, min_docs=3, top=200):
    """Rows (lang, source, text); nulls are ''."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in held.items()}
    total = defaultdict(Counter)
    for (lang, source), c in counts.items():
        for t in kept[lang]:
            total[lang][t] += c[t]
    p = lambda c, k: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in k) + len(k)) for t in k}
    f = lambda a, b: (a - b) ** 2 // b
    shares, whole, out = {g: p(c, kept[g[0]]) for g, c in counts.items()}, {lang: p(total[lang], k) for lang, k in kept.items()}, []
    for (lang, source), own in shares.items():
        pairs = [(-sum(f(own[t], q[t]) for t in kept[lang]), other.encode(), other) for (x, other), q in shares.items() if x == lang and other != source]
        terms = [(-f(own[t], whole[lang][t]), t.encode(), t) for t in kept[lang] if counts[lang, source][t] and own[t] > whole[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def test_divergence_by_definition(spark, odd):
    rng = random.Random(9)
    words = ["one", "Two", "three", "é", "É", "日本", "I", "ı", "😀"]
    rows = [(rng.choice(["a", "", None]), rng.choice(["s", "t", None, "é", "😀"]), " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for _ in range(150)] + [("bare", s, "") for s in "xyz"]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("x"), "n": F.lit(1), "p": F.lit(2)})
    for frame, given, top in ((df, rows, 3), (odd, [(r.lang, r.source, r.text) for r in odd.collect()], 200)):
        assert sorted(map(tuple, divergence.source_divergence(frame, top=top).collect())) == divergence_by_definition(given, top=top)
    assert divergence.source_divergence(odd.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    n, total, terms = 10**13, 3 * 10**13, 5
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + terms)
