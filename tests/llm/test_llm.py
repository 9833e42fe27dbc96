"""The corpus operators against brute force, round trips, held-out accuracy, and the odd inputs they define."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lodestrata.llm")

from pyspark.sql import functions as F  # noqa: E402

from lodestrata.llm import _text, chat, components, decontamination, kdtree, language_id, license_scan, packing, quality, simhash, substring_dedup, token_counts  # noqa: E402
from lodestrata.llm.queries import QUERIES, tokenizer  # noqa: E402

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no key here at all"), (5, LONG), (6, "<s>x</s> [INST] \\ <|endoftext|>")]


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return (t or "").encode().split()


# --- 5 -------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = QUERIES["op5_token_counts"](spark, SF).collect()
    text = {r.doc_id: r.text or "" for r in real(spark).collect()}
    assert len(rows) == real(spark).count()
    for r in rows:
        n = len(sp.encode(text[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 4096)


def test_token_counts_of_odd_strings():
    import sentencepiece

    f = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=f)
    r = random.Random(7)
    letters = "ab  the▁\n\t\réñß漢字😀<s></s>0123 ,.!aaaattiioonn\x00𝕏 "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [" " * k + w for k in range(0, 120, 7) for w in ("", "the", "\n")] + ["a" * 999, "the" * 400, "ab" * 300 + " x", "", "▁" * 40, "\n\n"]
    texts += [" ".join(sp.id_to_piece(r.randint(300, 31999)) + sp.id_to_piece(r.randint(300, 31999)) for _ in range(20)) for _ in range(300)]
    assert token_counts.count_tokens_of(texts, f) == [len(x) for x in sp.encode(texts)]


def test_token_counts_of_odd_rows(spark):
    got = token_counts.count_tokens(docs_of(spark, ODD).withColumn("n_tokens", F.lit("mine")), tokenizer("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.n_tokens) for r in got} >= {(1, 0), (2, 0), (4, 1)}
    assert token_counts.count_tokens(docs_of(spark, []), tokenizer("piece_bpe_32k.model")).count() == 0


def test_tokens_and_sequences_of_a_text_of_megabytes(spark):
    import sentencepiece

    long = "the quick brown fox, 12 ünï\n" * 60_000 + "x" * 3000 + "漢字" * 50_000
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    df = docs_of(spark, [(1, long), (2, "short")])
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, tokenizer("piece_bpe_32k.model")).collect()}
    assert got == {1: (len(long.encode()), len(sp.encode(long))), 2: (5, len(sp.encode("short")))}
    check_packing(packing.pack_documents(df, tokenizer("byte_bpe_50k.json")).collect(), [(1, long), (2, "short")])


# --- 10 ------------------------------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity=2048):
    """texts: of each row, in any order; rows with equal keys are told apart by their lengths only if they differ."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        if len(want[d]) > 1:
            assert sum(r.length for r in own) == sum(len(w) // 4 for w in want[d])
            continue
        at, ids = 0, want[d][0]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    return sum(packing._cost(sum(r.length for r in s), capacity) for s in sequences.values())


def test_packing_of_documents(spark):
    padding = check_packing(QUERIES["op10_packing"](spark, SF).collect(), [(r.doc_id, r.text) for r in real(spark).collect()])
    assert padding == 0


def test_packing_of_odd_rows(spark):
    check_packing(packing.pack_documents(docs_of(spark, ODD), tokenizer("byte_bpe_50k.json")).collect(), ODD)
    assert packing.pack_documents(docs_of(spark, []), tokenizer("byte_bpe_50k.json")).count() == 0


def test_ids_equal_the_library():
    e = packing.encoder(tokenizer("byte_bpe_50k.json"))
    r = random.Random(1)
    letters = "ab  the'sll\n\t\réñß漢字😀<|endoftext|>0123 ,.!aaa\x00\x1c\x1d𝕏 　\x85\xa0"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>b", " " * 9000 + "x", "a" * 50_000]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000], [2047, 2], [3, 3, 3], [700] * 50, list(range(1, 3000, 37))])
def test_pack_group_places_every_token_once(lengths):
    got = packing.pack_group(lengths, 2048)
    seen = {}
    for s in got:
        assert 0 < sum(n for *_, n in s) <= 2048
        for i, a, n in s:
            seen.setdefault(i, []).append((a, n))
    for i, n in enumerate(lengths):
        at = 0
        for a, m in sorted(seen[i]):
            assert a == at
            at += m
        assert at == n


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(3)
    sizes = [r.randint(1, 100) for _ in range(300)]
    free, want = [], []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(100)
            want.append([])
        free[k] -= sizes[i]
        want[k].append(i)
    assert packing.first_fit_decreasing(sizes, 100) == want


# --- 6 -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fp = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 2) + i + 1:
            up[root(int(j))] = root(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[root(i)] = min(d, groups.get(root(i), d))
    return [groups.get(root(i)) for i in range(len(rows))]


def test_simhash_components_equal_brute_force(spark):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in real(spark).collect()]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows), strict=True)}
    got = QUERIES["op6_simhash_bktree"](spark, SF).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_simhash_of_odd_rows(spark):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(docs_of(spark, ODD)).collect()}
    assert {(d, c) for d, f, c in got if f == 0} == {(1, 1), (2, 1), (3, 1)}
    assert {d for d, *_ in got} == {d for d, _ in ODD}
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_links_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    v = np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, r.integers(0, 4), False))) for b in base for _ in range(12)], np.uint64))
    a, b = simhash.spanning_links(v, 2)
    want = brute_components([(int(x), int(x)) for x in v])
    assert {int(x): int(y) for x, y in zip(a, b, strict=True)} == {int(x): c for x, c in zip(v, want, strict=True) if c != int(x)}


def test_hot_shards_are_searched_in_parts(spark):
    r = np.random.default_rng(3)
    v = np.unique(np.array([sum(1 << int(k) for k in r.choice(40, r.integers(0, 5), False)) for _ in range(400)], np.int64))
    want = dict(zip(v.tolist(), brute_components([(int(x), int(x)) for x in v]), strict=True))
    for hot_rows in (4096, 50):
        links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in v], "fp long"), 2, hot_rows)
        got = {x.node: x.root for x in components.connected_components(links).collect()}
        assert {k: got.get(k, k) for k in want} == want
    rows = [(k, " ".join(f"w{i}" for i in range(300) if i != 5 * k)) for k in range(50)]
    assert {x.component_id for x in simhash.similar_components(docs_of(spark, rows), hot_rows=7).collect()} == {0}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1051), 1000)}


def brute_similar(rows, similarity=0.8):
    """Components of exact Jaccard similarity over all pairs, as lists of smallest keys."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (a and len(a & sets[j]) >= similarity * len(a | sets[j])) or (not a and not sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(rows))]


def _forest_case(seed, n, apart):
    """Families around centres, one of them with half of all rows, with equal fingerprints among them."""
    r = np.random.default_rng(seed)
    centre = r.integers(0, 2**63, 20, dtype=np.uint64)
    of = np.where(r.random(n) < 0.5, 0, r.integers(0, 20, n))
    flips = np.bitwise_or.reduce(np.where(r.random((n, 4)) < 0.7, np.uint64(1) << r.integers(0, 64, (n, 4), dtype=np.uint64), np.uint64(0)), axis=1)
    planes = r.integers(0, 2**63, (20, 4), dtype=np.uint64)[of]
    return centre[of] ^ flips, planes, (r.integers(0, 2, n) if apart else np.zeros(n)).astype(np.int32)


def _roots_of(n, pairs):
    up = np.arange(n)
    simhash._hang(up, *np.array(pairs, np.int64).reshape(-1, 2).T)
    return simhash._roots(up, np.arange(n)).tolist()


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("n", [2, 60, 1500])
def test_near_duplicate_forest_is_what_all_pairs_give(n, apart):
    values, planes, part = _forest_case(n, n, apart)
    a, b = simhash.local_forest(values, 4, planes, 100, part)
    i, j = np.nonzero((np.bitwise_count(values[:, None] ^ values) <= 4) & (simhash.equal_places(planes[:, None], planes[None]) >= 100))
    want = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x < y and (part[x] != part[y] or (part == part[0]).all())]
    assert _roots_of(n, list(zip(a.tolist(), b.tolist(), strict=True))) == _roots_of(n, want) and (n == 2 or len(a))


def test_near_duplicate_candidates_come_from_bk_trees(monkeypatch):
    values, planes, part = _forest_case(1, 200, False)
    asked = []
    within = simhash.BkTree.within
    monkeypatch.setattr(simhash.BkTree, "within", lambda self, q, radius: asked.append(len(q)) or within(self, q, radius))
    assert len(simhash.local_forest(values, 4, planes, 100, part)[0]) and sum(asked) >= 200


def test_similar_components_find_near_copies(spark):
    r = random.Random(8)
    rows = []
    for k in range(40):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(900)) for _ in range(r.randint(150, 400))]
        rows.append((10 * k, " ".join(base)))
        for c in range(r.randint(0, 5)):  # copies with one word in a hundred and fifty changed
            near = list(base)
            for _ in range(len(base) // 150):
                near[r.randrange(len(near))] = "changed"
            rows.append((10 * k + 1 + c, " ".join(near)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1003, "ONE"), (None, rows[0][1])]
    got = {}
    for x in simhash.similar_components(docs_of(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append(x.component_id)
    keyed = [(d, t) for d, t in rows if d is not None]
    want = brute_similar(keyed)
    assert sum(map(len, got.values())) == len(keyed)
    assert [got[d][0] for d, _ in keyed] == want
    assert simhash.similar_components(docs_of(spark, [])).count() == 0


def test_similar_components_of_texts_that_differ_in_repeats_only(spark):
    r = random.Random(12)
    rows = []
    for k in range(30):
        line = " ".join(f"line{r.randrange(900)}" for _ in range(12))
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
        rows += [(10 * k, f"{base} {line} {line}"), (10 * k + 1, base + f" {line}" * 50)]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(docs_of(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == brute_similar(rows) == [d - d % 10 for d, _ in rows]


def test_similar_components_are_exact_at_the_limit(spark):
    r = random.Random(13)
    rows = []
    for k in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(304)]  # 300 shingles
        rows.append((1000 * k, " ".join(base)))
        for c, cut in enumerate((30, 36, 37, 40)):  # a tail of new words: cut of 300 shingles differ on either side
            rows.append((1000 * k + 1 + c, " ".join([*base[:-cut], *(f"x{c}y{r.randrange(10**6)}" for _ in range(cut))])))
        both = [f"w{r.randrange(10**6)}" for _ in range(304)]
        rows += [(1000 * k + 100, " ".join(both[:244])), (1000 * k + 101, " ".join(both)), (1000 * k + 110, " ".join(both[:243]))]  # 240/300, and 239
    rows = [x for x in rows if x[0] % 1000 != 110] + [(x[0] + 10**6, x[1]) for x in rows if x[0] % 1000 in (101, 110)]
    for hot_rows in (4096, 2):
        got = {x.doc_id: x.component_id for x in simhash.similar_components(docs_of(spark, rows), hot_rows=hot_rows).collect()}
        assert [got[d] for d, _ in rows] == brute_similar(rows)


def test_a_false_candidate_does_not_stop_the_search():
    sets = [np.arange(100), np.arange(30, 130), np.arange(1, 101), np.arange(28, 128), np.arange(12, 112)]
    same, one = np.zeros((5, 4), np.uint64), np.zeros(5, int)
    a, b = simhash.local_forest(np.zeros(5, np.uint64), 2, same, 100, one, lambda i, j: simhash.similar_sets(sets[i], sets[j], 0.75))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 0), (3, 1), (4, 0)]
    assert not simhash.similar_sets(sets[4], sets[1], 0.75) and len(simhash.local_forest(np.zeros(5, np.uint64), 2, same, 100, one)[0]) == 4


def test_sketches_estimate_similarity():
    r = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.8):
        both = r.integers(0, 2**63, int(4000 * share), dtype=np.uint64)
        h = np.concatenate([both, r.integers(0, 2**63, 4000 - len(both), dtype=np.uint64), both, r.integers(0, 2**63, 4000 - len(both), dtype=np.uint64)])
        _, planes = simhash.sketches(h, np.array([4000, 4000]))
        jaccard = len(both) / (8000 - len(both))
        assert abs(simhash.equal_places(planes[0], planes[1]) / simhash.PLACES - (jaccard + (1 - jaccard) / 4)) < 0.15


# --- 8 -------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window=13):
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                owner[k] = min(d, owner.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and owner[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted((str(x) for x in rows), key=str)


def test_substring_dedup_equals_brute_force(spark):
    got = [tuple(r) for r in QUERIES["op8_substring_dedup"](spark, SF).collect()]
    want = brute_repeats([(r.doc_id, r.text) for r in real(spark).collect()])
    assert key(got) == key(want)
    assert sum(r[2] for r in want) > 1000


def test_substring_dedup_of_runs_copies_and_odd_rows(spark):
    r = random.Random(5)
    rows = list(ODD)
    for i in range(10, 60):
        rows.append((i, " ".join(r.choice(["a", "b", "c"]) for _ in range(r.randint(0, 60)))))
    rows += [(70, "x " * 40), (71, "y " + "x " * 30 + "z"), (72, rows[10][1]), (72, "x " * 20), (None, "x " * 20), (73, "x " * 13)]
    got = substring_dedup.remove_repeats(docs_of(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert key(tuple(x) for x in got) == key(brute_repeats(rows))
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_and_passages_that_polynomials_confuse_are_told_apart(spark):
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    lead = " ".join(f"w{i}" for i in range(12))
    long = [" ".join(thue_morse(2048, p, q)) for p, q in (("a", "b"), ("b", "a"))]
    rows = [(1, f"{lead} {x}"), (2, f"{lead} {y}"), (3, f"{lead} {x} tail"), (4, long[0] + " u"), (5, "v " + long[1])]
    got = substring_dedup.remove_repeats(docs_of(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert key(tuple(r) for r in got) == key(brute_repeats(rows))
    assert {r.doc_id: r.n_removed for r in got}[2] == 0


def test_long_texts_in_parts_keep_the_same_words(monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "bb", "é漢", "x" * 70, "\t"]) for _ in range(r.choice([0, 3, 400]))) for _ in range(12)] + [None, "y" * 5000, " " * 900]
    gone = [[int(substring_dedup._pack(np.int64(r.randrange(0, 30)), np.int64(13))) for _ in range(3)] if i % 2 else None for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(gone, pa.list_(pa.int64()))], names=["text", "gone"])
    results = []
    for size in (1 << 20, 50, 300):
        monkeypatch.setattr(_text, "CHUNK_BYTES", size)
        monkeypatch.setattr(_text, "STEP", max(40, size // 4))
        monkeypatch.setattr(_text.pieces, "__defaults__", ("text", size, 1 << 16))
        out, h = [], {}
        for lo, hi, arrays in substring_dedup.kept_texts(batch, 0, 1):
            out += zip(range(lo, hi), *(a.to_pylist() for a in arrays), strict=True)
        for lo, _, w, first, base in _text.word_runs(batch, 0, 12):
            for i in range(len(first) - 1):
                for k, v in enumerate(w[first[i] : first[i + 1]].tolist()):
                    assert h.setdefault((lo + i, base + k), v) == v
        results.append((out, h, simhash.fingerprints_of(texts).tolist(), [sorted(x) for x in [simhash.shingle_hashes(texts, 5)[0].tolist()]]))
    assert all(x == results[0] for x in results[1:])
    for i, kept, total, removed in results[0][0]:
        w = words(texts[i])
        drop = {k for p in gone[i] or [] for k in range(p >> 32, (p >> 32) + (p & 0x7FFFFFFF))}
        left = [x for k, x in enumerate(w) if k not in drop]
        assert (kept.encode(), total, removed) == (b" ".join(left), len(w), len(w) - len(left))


def test_further_columns_may_have_any_name(spark):
    def more(df):
        return df.select("*", *[F.lit("x").alias(c) for c in ("uid", "at", "doc", "c0", "said", "__text", "SCORE", "N_TOKENS", "Kept_Text", "LANG_PRED", "predicted", "n_bytes", "settled", "row_key", "place", "TEXT")])

    rows = [(1, "one two three"), (2, None), (None, "one two three")]
    docs = more(docs_of(spark, rows))
    results = {
        "kept_text": substring_dedup.remove_repeats(docs),
        "n_tokens": token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")),
        "lang_pred": language_id.identify_language(docs, (("en", "one two"),)),
        "score": quality.score_quality(docs, quality.fit_quality_of(docs, more(spark.createDataFrame([(1, 1)], "doc_id long, quality int")))),
    }
    for name, df in results.items():
        names = [c.lower() for c in df.columns]
        assert names.count(name) == 1 and names.count("settled") == 1
        at = names.index("doc_id")
        assert sorted(str(r[at]) for r in df.collect()) == ["1", "2", "None"]
    assert simhash.simhash_components(docs).count() == 3 and simhash.similar_components(docs).count() == 2
    assert packing.pack_documents(docs, tokenizer("byte_bpe_50k.json")).count() == 3
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string").select("*", F.lit(1).alias("shard"), F.lit("x").alias("Text"), F.lit(0).alias("id"))
    assert sorted(str(r.doc_id) for r in decontamination.find_contamination(docs, items).collect()) == ["1", "None"]
    turns = more(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(chat.format_conversations(turns)).count() == 1
    assert license_scan.scan_licenses(docs).count() == 0


def test_equal_windows_have_equal_cores():
    r = random.Random(2)
    for _ in range(100):
        vocabulary = r.choice([2, 3, 10, 1000])
        texts = [[r.randrange(vocabulary) for _ in range(r.randint(0, 80))] for _ in range(6)]
        passage = [r.randrange(vocabulary) for _ in range(r.choice([13, 14, 20, 40]))]
        for t in r.sample(texts, 3):
            t[5:5] = passage
        w = _text.mix(np.array([v * 7919 + 11 for t in texts for v in t], np.uint64))
        first = np.r_[0, np.cumsum([len(t) for t in texts])]
        core = {(row, s + q): name for name, row, s, n in zip(*substring_dedup.cores_of(w, first), strict=True) for q in range(n)}
        by = {}
        places = [(i, q) for i, t in enumerate(texts) for q in range(len(t) - 12)]
        assert set(core) == set(places)
        for i, q in places:
            assert by.setdefault(tuple(texts[i][q : q + 13]), core[i, q]) == core[i, q]


# --- 7 and 4 ---------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in real(spark).collect()}
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99


def test_suffix_automaton_accepts_substrings_only():
    r = random.Random(4)
    s = [r.randrange(3) for _ in range(60)]
    step = language_id.suffix_automaton(s)
    every = {tuple(s[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(2000):
        t = tuple(r.randrange(3) for _ in range(r.randint(0, 8)))
        at = 0
        for c in t:
            at = step[at].get(c, -1) if at >= 0 else -1
        assert (at >= 0) == (t in every)


def test_phrases_equal_a_plain_parse():
    sample = (("en", "the cat sat on the mat and the dog ran"), ("de", "der hund lief und die katze sass"))
    p = language_id.CrossParser(sample)
    for text in ("the dog sat on der katze", "xyz", "e" * 50, "The, CAT!!"):
        symbols = p.symbols(language_id.letters_of(text)).tolist()
        got = p.entropies([text])[0]
        for k, (_, said) in enumerate(sample):
            own = p.symbols(language_id.letters_of(said)).tolist()
            subs = {tuple(own[i:j]) for i in range(len(own)) for j in range(i, len(own) + 1)}
            n, phrase = 1, ()
            for c in symbols:
                if (*phrase, c) in subs:
                    phrase = (*phrase, c)
                else:
                    n, phrase = n + 1, ((c,) if (c,) in subs else ())
            assert got[k] == pytest.approx(n * p.bits[k] / len(symbols))


def plain_phrases(automaton, symbols):
    n, state = 1, 0
    for c in symbols:
        v = automaton.one(state, c)
        n, state = (n + 1, ~v) if v < 0 else (n, v)
    return n


@pytest.mark.parametrize(("block", "stretch", "cells"), [(512, 1 << 20, 1 << 24), (512, 1024, 1), (4, 16, 1 << 24), (2, 6, 1)])
def test_phrases_are_those_of_one_parse_of_the_whole_text(monkeypatch, block, stretch, cells):
    r = random.Random(block)
    for name, v in (("BLOCK", block), ("STRETCH", stretch), ("DENSE_CELLS", cells)):
        monkeypatch.setattr(language_id, name, v)
    for letters in ("a", "ab", "abcde ", "abcde q"):
        said = ["".join(r.choice(letters.replace("q", "")) for _ in range(n)) for n in (20, 200, 6000 if block > 9 else 90)]
        p = language_id.CrossParser(tuple(zip("xyz", said, strict=True)))
        texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 40 * block // 3))) for _ in range(5)] + [*said, said[2] * 2, said[1][:7] * 60]
        rows = [p.symbols(language_id.letters_of(t)) for t in texts]
        got = p.phrases(rows)
        assert got.tolist() == [[plain_phrases(a, x.tolist()) for a in p.automata] for x in rows]
        assert got[7, 2] == 1  # a text that is its language's sample


def test_language_query_equals_a_plain_parse(spark):
    docs = {r.doc_id: r for r in real(spark).collect()}
    labelled = [r for d, r in docs.items() if zlib.crc32(str(d).encode()) % 3 != 1]
    sample = language_id.fit_language_sample(spark.createDataFrame(labelled))
    assert {k for k, _ in sample} == {r.lang for r in labelled if r.lang} and all(len(v) <= language_id.CHARS_PER_LANGUAGE + language_id.DOCS_PER_LANGUAGE for _, v in sample)
    p = language_id.CrossParser(sample)
    for r in QUERIES["op7_language_id"](spark, SF).collect()[::7]:
        x = p.symbols(language_id.letters_of(docs[r.doc_id].text or ""))
        if r.lang_pred != "und":
            bits = [plain_phrases(a, x.tolist()) * b / len(x) for a, b in zip(p.automata, p.bits, strict=True)]
            assert p.languages[int(np.argmin(bits))] == r.lang_pred
            assert r.score == pytest.approx(1 / sum(2 ** -((b - min(bits)) * language_id.SHARPNESS) for b in bits))


def test_a_language_of_long_rows_only_and_many_languages_are_learned(spark):
    rows = [(i, "ab cd " * 9000, "xx", "s", 1) for i in range(3)] + [(10 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, f"l{i}", "s", 1) for i in range(300)]
    sample = dict(language_id.fit_language_sample(spark.createDataFrame(rows, DOCS)))
    assert len(sample) == 301 and len(sample["xx"]) == language_id.SAMPLE_CHARS // 301


def test_a_language_column_with_very_many_values(spark, monkeypatch):
    rows = [(k, f"text {k} of some language", f"x{k % 2500}", "s", 1) for k in range(5000)]
    df = spark.createDataFrame(rows, DOCS)
    sample = language_id.fit_language_sample(df)
    assert len(sample) == 2500 and all(0 < len(t) <= language_id.SAMPLE_CHARS // 2500 + 1 for _, t in sample)
    monkeypatch.setattr(language_id, "LISTED_KEYS", 0)
    assert language_id.fit_language_sample(df) == sample


def test_languages_of_large_alphabets_and_of_all_planes(monkeypatch):
    r = random.Random(4)

    def prose(letters, seed, n):
        vocabulary = ["".join(random.Random(seed * 1000 + i).choices(letters, k=3)) for i in range(300)]
        return " ".join(r.choice(vocabulary) for _ in range(n))

    common, one, two = [chr(0x4E00 + k) for k in range(250)], [chr(0x5000 + k) for k in range(900)], [chr(0xAC00 + k) for k in range(900)]
    high, other = [chr(0x10450 + k) for k in range(40)], [chr(0x20000 + k) for k in range(300)]
    kinds = {"aa": common, "bb": one, "cc": two, "dd": high, "ee": other}
    sample = tuple((k, prose(x, ord(k[0]), 3000)) for k, x in kinds.items())
    for _ in range(2):
        lang, score = language_id.CrossParser(sample).predict([prose(x, ord(k[0]), 40) for k, x in kinds.items()])
        assert lang == list(kinds) and min(score) > 0.9
        monkeypatch.setattr(language_id, "DENSE_CELLS", 1)  # all sparse
    assert language_id.letters_of("\U00010400b").tolist() == [0x10428, ord("b")]


def test_dense_and_sparse_automata_step_alike():
    text = [random.Random(2).choice([0, 3, 4, 5, 6]) for _ in range(400)]
    step = language_id.suffix_automaton(text)
    a, b = language_id.Dense(step, 9), language_id.Sparse(step, 9)
    s, c = (np.repeat(np.arange(len(step)), 9).astype(np.int32), np.tile(np.arange(9), len(step)).astype(np.int32))
    assert (b(s.copy(), c) == a(s.copy(), c)).all()


def test_language_of_odd_rows(spark):
    rows = docs_of(spark, [*ODD, (9, "12 34 ..."), (10, "ñ" * 30)]).withColumn("score", F.lit("mine"))
    got = language_id.identify_language(rows, (("en", "some text"),)).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert {r.lang_pred for r in language_id.identify_language(rows, ()).collect()} == {"und"}
    assert language_id.identify_language(docs_of(spark, []), (("en", "x"),)).count() == 0
    assert language_id.fit_language_sample(docs_of(spark, [])) == ()


def test_quality_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, SF).collect()
    assert len(rows) == real(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    bad = [r for r in held if label[r.doc_id] == 0]
    assert bad and np.mean([r.predicted == 0 for r in bad]) > 0.8


def test_quality_votes_equal_a_plain_vote():
    r = np.random.default_rng(1)
    x = r.integers(0, 5, (60, quality.DIMENSIONS)).astype(np.float32)
    y = r.integers(0, 2, 60)
    m = quality.fit_neighbours(x, y)
    v = m.latent(x[:5])
    for got, q in zip(m.scores(x[:5]), v, strict=True):
        near = sorted(zip(m.vectors @ q, y, strict=True), key=lambda z: -z[0])[: quality.NEIGHBOURS]
        w = [max(s, 0) ** 4 for s, _ in near]
        assert got == pytest.approx((sum(a * b for a, (_, b) in zip(w, near, strict=True)) + 0.5 * m.prior) / (sum(w) + 0.5), rel=1e-4)


def test_quality_query_equals_a_plain_vote(spark):
    docs = {r.doc_id: r.text or "" for r in real(spark).collect()}
    held_in = {d for d in docs if zlib.crc32(str(d).encode()) % 5}
    known = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in held_in)
    counts = {}
    for d in docs:
        ((_, x),) = quality.features_of(pa.RecordBatch.from_arrays([pa.array([docs[d]])], names=["text"]))
        counts[d] = x[0]
    m = quality.fit_neighbours(np.stack([counts[d] for d, _ in known]), np.array([y for _, y in known]))
    for r in QUERIES["op4_quality"](spark, SF).collect():
        cos = np.round(m.vectors @ m.latent(counts[r.doc_id][None])[0], 6)
        near = sorted(zip(cos.tolist(), m.labels.tolist(), strict=True), key=lambda z: -z[0])[: quality.NEIGHBOURS]
        w = [max(c, 0) ** 4 for c, _ in near]
        assert r.score == pytest.approx((sum(a * b for a, (_, b) in zip(w, near, strict=True)) + 0.5 * m.prior) / (sum(w) + 0.5), abs=1e-5)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (6, None), (7, 9)], "doc_id long, quality int")
    model = quality.fit_quality_of(docs_of(spark, ODD), labels)
    got = quality.score_quality(docs_of(spark, ODD).withColumn("score", F.lit("mine")), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality.fit_quality_of(docs_of(spark, []), labels)
    assert {r.score for r in quality.score_quality(docs_of(spark, ODD), none).collect()} == {0.5}
    assert quality.score_quality(docs_of(spark, []), model).count() == 0


# --- 1 -------------------------------------------------------------------------------------------------------------


def brute_contamination(texts, items):
    """Every passage against every item, scored in full; the best passage counts."""
    halves = [decontamination.question_and_answer(t) for _, t in items]
    index = decontamination.BenchmarkIndex([i for i, _ in items], [q for q, _ in halves], [a for _, a in halves])
    place = {t: k for k, t in enumerate(index.vocabulary.tolist())}
    score = [{} for _ in index.item_ids]
    for t, p in enumerate(index.postings):
        for i, s in zip(p.items, p.share, strict=True):
            score[i][t] = s
    out = set()
    for row, said in enumerate(decontamination.words_of(texts)):
        n = index.longest
        for at in range(0, max(1, len(said)), n):
            have = {place[t] for t in said[at : at + 2 * n].tolist() if t in place}
            for i, s in enumerate(score):
                if sum(v for t, v in s.items() if t in have) >= decontamination.THRESHOLD - 1e-12:
                    shares = [len(g & set(decontamination._window_hashes(said, k).tolist())) / len(g) if k else 1.0 for k, g in index.parts[i]]
                    if min(shares) >= decontamination.OVERLAP:
                        out.add((row, index.item_ids[i]))
    return out


def test_contamination_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = real(spark).orderBy("doc_id").limit(400).collect()
    got = decontamination.find_contamination(spark.createDataFrame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    at = {d.doc_id: k for k, d in enumerate(docs)}
    assert {(at[r.doc_id], r.item_id) for r in got} == brute_contamination([d.text or "" for d in docs], items)
    assert got


def test_decontaminate_query_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = real(spark).collect()
    got = QUERIES["op1_decontaminate"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(docs[k].doc_id, i) for k, i in brute_contamination([d.text or "" for d in docs], items)}


def test_items_in_several_indexes_give_the_same_rows(spark, monkeypatch):
    items, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), real(spark)
    want = sorted(decontamination.find_contamination(docs, items).collect())
    total = sum(len(r.text.encode()) for r in items.collect())
    for parts in (2, 7):
        monkeypatch.setattr(decontamination, "SHARD_BYTES", -(-total // parts))
        assert sorted(decontamination.find_contamination(docs, items).collect()) == want
    assert want


def test_contamination_of_long_texts_in_parts():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [" ".join(r.choices(vocabulary, k=r.randint(5, 40))) for _ in range(40)]
    halves = [decontamination.question_and_answer(t) for t in items]
    index = decontamination.BenchmarkIndex(list(range(40)), [q for q, _ in halves], [a for _, a in halves])
    texts = [" ".join([*r.choices(vocabulary, k=300), items[k], *r.choices(vocabulary, k=300)]) for k in range(20)]
    want = {(x[0], x[1]): x[2:] for x in index.contaminations(pa.array(texts), 0.5, 0.5)}
    for size in (150, 700):
        decontamination.PIECE_BYTES = size
        try:
            assert {(x[0], x[1]): x[2:] for x in index.contaminations(pa.array(texts), 0.5, 0.5)} == want
        finally:
            decontamination.PIECE_BYTES = 1 << 20
    assert {(k, k) for k in range(20)} <= set(want)


def test_wand_returns_all_above_the_threshold():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(120)]
    items = [" ".join(r.choices(vocabulary, k=r.randint(5, 40))) for _ in range(150)]
    index = decontamination.BenchmarkIndex(list(range(150)), items, [""] * 150)
    for _ in range(500):
        terms, threshold = r.sample(range(len(index.postings)), r.randint(1, 60)), r.choice([0.05, 0.2, 0.5, 0.8])
        want = {}
        for t in terms:
            for i, s in zip(index.postings[t].items, index.postings[t].share, strict=True):
                want[i] = want.get(i, 0) + s
        assert sorted(i for i, _ in index.wand(terms, threshold)) == sorted(i for i, s in want.items() if s >= threshold - 1e-12)


def test_contamination_of_odd_rows(spark):
    item = "What is the capital of a made up country? It is the town of Lorem on the river Ipsum."
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (3, None), (4, ""), (None, item), (5, "...")], "item_id long, text string")
    rows = [*ODD, (20, f"Before. {item.upper()} After."), (21, item.replace(" ", "\n")), (22, item[:30]), (None, item), (23, LONG + item + LONG)]
    got = sorted((r.doc_id or -1, r.item_id) for r in decontamination.find_contamination(docs_of(spark, rows), items).collect())
    assert got == [(d, i) for d in (-1, 20, 21, 23) for i in (1, 1, 2)]
    assert decontamination.find_contamination(docs_of(spark, []), items).count() == 0
    assert decontamination.find_contamination(docs_of(spark, rows), items.where("false")).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)) for r in rows}
    want = set()
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in QUERIES["op2_topk_kdtree"](spark, SF).collect()} == want


def test_top_k_of_ties_and_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [3.0, 1.0]), (3, [3.0, 1.0]), (4, None), (5, []), (6, [1.0, None]), (7, [inf, 0.0]), (8, [nan, 1.0]), (None, [9.0, 9.0]), (9, [5.0]), (50, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()}
    assert got == {(0, 1, 1, 5), (0, 2, 2, 5), (0, 3, 3, 5), (50, 1, 0, -3), (50, 2, 1, -4), (50, 3, 2, -4)}
    assert kdtree.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_rows_that_share_a_key_and_of_large_products(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 3.0]), (7, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("x").alias("VEC_id"), F.lit(1).alias("c0"), F.lit(2).alias("asked"))
    got = sorted(tuple(r) for r in kdtree.top_k(df, F.lit(True), k=2).collect())
    want = []
    for n, (i, v) in enumerate(rows):
        best = sorted((-int(np.dot(v, x)), c) for m, (c, x) in enumerate(rows) if m != n)[:2]
        want += [(i, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    big = [(0, [94906267.0, 123.0]), (1, [94906267.0, 1.0]), (2, [94906267.0, 2.0]), (3, [1.0, 1.0])]
    got = sorted(tuple(r) for r in kdtree.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect())
    assert got == [(0, k + 1, c, s) for k, (s, c) in enumerate(sorted(((sum(int(a) * int(b) for a, b in zip(big[0][1], v, strict=True)), i) for i, v in big[1:]), key=lambda x: (-x[0], x[1])))]


def test_top_k_in_several_query_blocks_and_shards(spark, monkeypatch):
    r = np.random.default_rng(2)
    m = r.integers(-300, 300, (900, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(kdtree, "QUERY_BYTES", 6 * 8 * 5)
    got = {tuple(x) for x in kdtree.top_k(df, F.col("vec_id") % 50 == 0, k=4).collect()}
    want = set()
    for q in range(0, 900, 50):
        best = sorted((-int(m[q] @ m[i]), i) for i in range(900) if i != q)[:4]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_kd_tree_boxes_are_tight_and_search_prunes():
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8)) * 50
    m = np.floor(np.repeat(centres, 200, 0) + r.normal(size=(4000, 8)))
    tree = kdtree.KdTree(m, leaf=64)
    for k in range(len(tree.left)):
        part = tree.vectors[tree.begin[k] : tree.end[k]]
        assert (part.min(0) == tree.low[k]).all() and (part.max(0) == tree.high[k]).all()
    ids = np.arange(4000)
    got = {j: list(zip((-s).tolist(), i.tolist(), strict=True)) for j, i, s in kdtree.search(tree, ids, m[:20], ids[:20], 5, np.full(20, -np.inf))}
    for j in range(20):
        assert sorted(got[j]) == sorted((-(m[j] @ m[i]), i) for i in range(4000) if i != j)[:5]


# --- 3 -------------------------------------------------------------------------------------------------------------


def digests(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back_what_was_said(spark):
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(turns)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "\\"), (2, 0, "assistant", "\\:<\\:s>"), (2, 0, "assistant", "\\:<\\:s>"), (3, 0, None, "<<ROLE>>"), (3, 1, "tool<</ROLE>>", "[/INST] </"), (None, 0, "user", "a"), (None, 1, "assistant", "漢😀"), (4, None, "system", ""), (4, 0, "user", "<</TURN>>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3, None, 4):
        turns = [(r, t) for k, _, r, t in rows if k == c]
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == digests(turns)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_escape_is_reversible_and_hides_controls():
    t, r = chat.INSTRUCTION, random.Random(9)
    parts = [*t.control, "\\", ":", "<", ">", "[", "]", "/", "s", " ", "x"]
    for _ in range(5000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        e = t.escape(s)
        assert t.unescape(e) == s and not any(c in e for c in t.control)


# --- 9 -------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = license_scan.KNOWN[2][1]
    rows = [(1, "Intro.\nreleased UNDER the mit licence\nMore."), (2, "Copyright (c) 2024 Someone\n\n" + mit.replace(". ", ".\n")), (3, "Released under the MIT License. But not only."), (4, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (5, None), (6, ""), (7, LONG)]
    got = {(r.doc_id, r.license_id, r.n_lines, r.whole_text) for r in license_scan.scan_licenses(docs_of(spark, rows).withColumn("license_id", F.lit("x"))).collect()}
    assert got == {(1, "MIT", 1, False), (2, "MIT", 0, True), (4, "CC-BY-NC-4.0", 3, True), (None, "MIT", 1, True)}
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0


def test_license_files_with_titles_wrapped_notices_and_code(spark):
    known = dict(license_scan.known_texts())
    assert all(any(m in t.lower() for m in license_scan.MARKS) for t in known.values())
    header = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License."
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + known["MIT"]),
        (2, "Copyright 2019 A\n\n" + known["ISC"]),
        (3, header + "\n\nimport os\n"),
        (4, "/*\n * The MIT License (MIT)\n *\n * " + known["MIT"].replace("\n", "\n * ") + "\n */\n\nint main() {}\n\nreturn 0;"),
        (5, known["GPL-3.0"]),
        (6, known["BSD-3-Clause"].replace("copyright notice", "copyright  NOTICE").replace("HOLDERS", "OWNERS")),
        (7, known["MIT"].replace("sublicense", "sell")),
        (8, "The conversion licensed under the Apache License, Version 2.0 today."),
        (9, "Licensed under the Apache License,\nversion 2.0.\n\n\n" + known["BSD-2-Clause"] + "\n\nmore"),
        (10, known["ISC"].replace("\n", "\r\n")),
        (11, "\n" * 50_000 + "license" + " \n" * 50_000),
    ]
    got = {(r.doc_id, r.license_id): (r.n_lines, r.n_paragraph_runs, r.whole_text) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {(1, "MIT"): (0, 1, True), (2, "ISC"): (0, 1, True), (3, "Apache-2.0"): (0, 1, False), (4, "MIT"): (0, 1, False), (5, "GPL-3.0"): (0, 1, True), (6, "BSD-3-Clause"): (0, 1, True), (9, "Apache-2.0"): (0, 1, False), (9, "BSD-2-Clause"): (0, 1, False), (10, "ISC"): (0, 1, True)}


#: Notices as they stand in files, and what they are; written by hand, not from the scan's lists.
IN_THE_WILD = {
    "GPL-3.0": """# frobnicate - turns knobs
# Copyright (C) 2021  A. N. Author
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.

import sys
""",
    "GPL-2.0": "/*\n * This file is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published\n * by the Free Software Foundation; version 2 of the License.\n */\nint x;",
    "LGPL-2.1": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,""",
    "AGPL-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU Affero General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\nrest",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n\nlet x = 1;",
    "MIT": "// SPDX-License-Identifier: MIT\npackage main",
    "Apache-2.0": "prose before\nThis software is licensed under the Apache License, Version 2.0.\nprose after",
    "BSD-3-Clause": "This project is released under the New BSD License\n",
    "CC-BY-SA-4.0": "This work is licensed under a lot of things.\nThe code is available under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-3.0": "# SPDX-License-Identifier: LGPL-3.0-or-later",
    "EPL-2.0": "Distributed under the EPL 2.0.",
    "GPL-1.0": "    This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
}


def test_notices_as_they_stand_in_files(spark):
    near = ["This program is free software in spirit.", "SPDX-License-Identifier: MIT-ish", "They spoke of what is licensed under the MIT License.", "Provided under protest.", "This program is distributed in the hope that it will be useful."]
    rows = list(enumerate([*IN_THE_WILD.values(), *near]))
    got = {(r.doc_id, r.license_id) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == set(enumerate(IN_THE_WILD))


def test_license_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(license_scan.oracle()).fetchall())
    assert want and sorted(tuple(r) for r in QUERIES["op9_license_scan"](spark, SF).collect()) == want


def test_main_path_of_the_license_scan_is_native(spark):
    plan = license_scan.scan_licenses(real(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(11)
    prose = [x.text for x in real(spark).orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id = 3").first().text
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100, prose[3]), (100, prose[3]), (101, "1234 5678 ..."), (102, None), (103, ""), (104, f"{prose[5]} {item}"), (105, item)]
    shared = " ".join(r.choice(prose[7].split()) for _ in range(60))
    rows += [(120, prose[20]), (121, prose[20].replace(" the ", " that ", 1))]
    rows += [(110, f"{prose[9][:400]} {shared}"), (111, f"{prose[11][:400]} {shared} {prose[12][:200]}"), (112, shared)]
    os.makedirs(tmp_path / "sf")
    real(spark).limit(0).unionByName(docs_of(spark, rows)).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "sf/documents.parquet")), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = str(tmp_path / f"out{k}")
        before = docs.collect()
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append((name, before, docs.collect()))
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
    (_, b0, a0), (_, b1, a1), (_, b2, a2), (_, b3, a3), (_, b4, a4) = seen
    assert {x.doc_id for x in b0} - {x.doc_id for x in a0} == {101, 102, 103}
    assert sorted(x.doc_id for x in a1) == sorted(set(brute_similar([(x.doc_id, x.text) for x in b1])))
    assert not {120, 121} & {x.doc_id for x in a1}
    want = {d: (n - gone, gone) for d, n, gone, _ in brute_repeats([(x.doc_id, x.text) for x in b2])}
    assert {x.doc_id: len(words(x.text)) for x in a2} == {d: left for d, (left, gone) in want.items() if left or not gone}
    hit = brute_contamination([x.text for x in b3], [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert sorted(x.doc_id for x in a3) == sorted(x.doc_id for k, x in enumerate(b3) if k not in {h for h, _ in hit})
    check_packing(a4, [(x.doc_id, x.text) for x in b4])


def test_pipeline_stages_of_rows_without_an_id_or_with_one_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = [x.text for x in real(spark).where("length(text) > 800").orderBy("doc_id").limit(4).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id = 3").first().text
    leaks = docs_of(spark, [(None, f"{prose[0]} {item}"), (None, prose[0]), (7, f"{prose[1]} {item}"), (7, prose[2])])
    assert {(x.doc_id, x.text) for x in pipeline.benchmark_leaks(spark, leaks, SF).collect()} == {(None, prose[0]), (7, prose[2])}
    near = docs_of(spark, [(None, prose[0]), (3, prose[0]), (None, prose[1]), (None, prose[1]), (None, f"{prose[1]} more"), (5, prose[2]), (5, prose[3]), (5, prose[3])])
    left = [(x.doc_id, x.text) for x in pipeline.near_duplicates(spark, near, SF).collect()]
    assert sorted(x for x in left if x[0]) == sorted([(3, prose[0]), (5, prose[2]), (5, prose[3])])
    assert len(left) == 4 and [x[1].startswith(prose[1]) for x in left if x[0] is None] == [True]
    shared = " ".join(f"s{k}" for k in range(40))
    cut = pipeline.repeated_passages(spark, docs_of(spark, [(9, f"{shared} nine"), (None, f"none {shared}")]), SF).collect()
    assert {(x.doc_id, x.text) for x in cut} == {(9, f"{shared} nine"), (None, "none")}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_text_buffers_of_sliced_batches():
    b = pa.RecordBatch.from_arrays([pa.array(["a b", None, "", "é  c\td", "a b"])], names=["text"])
    for part in (b, b.slice(2, 3)):
        got = []
        for lo, hi, buf, off, _, _ in _text.pieces(part, limit=4):
            h, first = _text.word_hashes(buf, off)
            got += [h[x:y].tolist() for x, y in zip(first, first[1:], strict=False)]
        assert [len(x) for x in got] == [len((t or "").split()) for t in part.column(0).to_pylist()]
    assert got[-1] == [x for x in _text.word_hashes(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0].tolist()]
