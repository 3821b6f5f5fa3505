"""Operators of the llm subpackage against brute force, round trips and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import embed, graph, kernels, near, ordinal, packing, quality_rules, queries, spm, substring, suffix, toxicity, urls
from foliant.workspace import Workspace

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, kept string, score double"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lor", "min", "nat", "per", "ros", "tik")]


def said(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(4)
    base, passage = said(rng, 200), said(rng, 80)
    texts = [None, "", " \n\t", "x", base, base, base.replace(base.split()[50], "other"), said(rng, 100) + " " + passage + " " + said(rng, 50), said(rng, 20) + " " + passage, said(rng, 3000), "le " * 300, "é ñ 日本 " * 60, "<|endoftext|> a", "one line\n\nother\none line"]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), None, "clash", "clash", 1.0) for i, t in enumerate(texts)]
    return [*out, out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_counts_by_brute_force(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count, covered = collections.Counter(windows), set()
        for k, w in enumerate(windows):
            if count[w] > 1:
                covered |= {k, k + 1, k + 2}
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    assert got == sorted(want)
    assert quality_rules.judge(empty).count() == 0


def test_chi2():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def suffix_brute(texts, n):
    count = collections.Counter(b[k : k + n] for b in texts for k in range(len(b) - n + 1))
    for b in texts:
        covered = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                covered[k : k + n] = b"\1" * n
        yield len(b), sum(covered), sum(c and (not k or not covered[k - 1]) for k, c in enumerate(covered)), hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()


@pytest.mark.parametrize(("window", "hot"), [(400, suffix.HOT), (90, suffix.HOT), (400, 1), (90, 2)])
def test_suffix_by_brute_force(docs, rows, empty, window, hot):
    got = sorted(tuple(r)[1:] for r in suffix.remove_repeats(docs, window=window, anchor=64 if window == 400 else 20, hot=hot).collect())
    assert got == sorted(suffix_brute([(r[1] or "").encode() for r in rows], window))
    assert suffix.remove_repeats(empty).count() == 0


def test_tables_hold_whole_groups():
    keys = np.sort(np.random.default_rng(3).integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 17])], ["key"]) for i in range(0, 500, 17)]
    tables = [t.column(0).to_numpy() for t in suffix.whole_groups(iter(batches), 50)]
    assert np.array_equal(np.concatenate(tables), keys) and len(tables) > 4
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_deep_shallow_sorts():
    rng = random.Random(2)
    strings = sorted({b"p" * 8 + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) + b"q" * rng.choice((0, 50)) for _ in range(400)}, key=lambda _: rng.random())
    order = suffix.deep_shallow(strings, list(range(len(strings))), 8, 6)
    assert [strings[i] for i, _ in order] == sorted(strings)
    for (a, _), (b, shared) in zip(order, order[1:]):
        assert shared == suffix.common(strings[a], strings[b])


def test_compact_windows_cover_each_sequence_once():
    rng = np.random.default_rng(1)
    values, first, width = rng.integers(0, 1 << 63, 120).astype(np.uint64), np.array([0, 70, 120]), 9
    got = substring.compact_windows(values, first, width)
    for a, b in zip(first, first[1:]):
        for i in range(a, b):
            for j in range(i + width - 1, b):
                held = [c for left, c, right in got if left <= i <= c <= j <= right]
                assert held == [i + int(np.argmin(values[i : j + 1]))]


@pytest.mark.parametrize("words", [40, 3])
def test_joint_windows_by_brute_force(words):
    """Any two windows of different functions that hold each other's top and a passage."""
    rng, width = np.random.default_rng(2), 5
    tokens = rng.integers(0, words, 90).astype(np.uint64)
    first, keys, packed, spans = np.array([0, 90]), [], [], []
    for which, salt in enumerate(substring.SALTS):
        values = (kernels.mix(tokens ^ np.uint64(salt)) & ~np.uint64(3)) | np.uint64(which)
        for left, top, right in substring.compact_windows(values, first, width):
            keys.append(int(values[top]))
            packed.append(top << 38 | (top - left) << 19 | (right - top))
            spans.append((which, left, top, right))
    got, _ = substring.joint_windows(np.array(keys, np.uint64).view(np.int64), np.array(packed, np.int64), width)
    want = set()
    for (f, l1, c1, r1), a in zip(spans, keys):
        for (g, l2, c2, r2), b in zip(spans, keys):
            if f < g and l1 <= c2 <= r1 and l2 <= c1 <= r2 and min(r1, r2) - max(l1, l2) + 1 >= width:
                want.add((a * 0xD6E8FEB86659FD93 + b) % 2**64)
    want = set(kernels.mix(np.array(sorted(want), np.uint64)).view(np.int64).tolist())
    assert set(got.tolist()) == want


def shared_passages(texts, least, width=46):
    """Texts that hold a passage of 50 words like one of another text, on some diagonal of shingles in common."""
    shingles = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (t.split() for t in texts)]
    places = [{g: k for k, g in reversed(list(enumerate(x)))} for x in shingles]
    out = set()
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles):
            shifts = collections.Counter(k - places[j][g] for k, g in enumerate(a) if g in places[j]) if i != j else {}
            for shift, n in shifts.items():
                for s in range(max(0, shift), min(len(a), len(b) + shift) - width + 1) if n >= 10 else ():
                    x, y = set(a[s : s + width]), set(b[s - shift : s - shift + width])
                    if len(x & y) >= least * len(x | y):
                        out.add(i)
                        break
    return out


def test_passages_by_brute_force(spark):
    """Passages of 60 words with up to two words changed, in texts that share frequent phrases; some in three texts."""
    rng = random.Random(15)
    phrases = [said(rng, 12) for _ in range(3)]
    filler = lambda: " ".join(x for _ in range(4) for x in (said(rng, rng.randint(15, 40)), rng.choice(phrases)))
    texts, planted = [filler() for _ in range(40)], []
    for k in range(40):
        words = said(rng, 60).split()
        for _ in range(2 + (k % 3 == 0)):
            own = list(words)
            for at in rng.sample(range(60), k % 3):
                own[at] = said(rng, 1) + "q"
            planted.append((len(texts), k % 3))
            texts.append(f"{filler()} {' '.join(own)} {filler()}")
    got = {r.doc_id for r in substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    equal = {i for i, edits in planted if edits == 0}
    assert equal <= got
    want = shared_passages(texts, 0.8)
    assert len(want & got) >= 0.9 * len(want)
    assert not got & set(range(40))


def test_passages_of_members_that_are_like_neither_end_of_a_key(spark):
    """Families of two texts share 55 words, of which all families share 35: the texts of a key's ends belong to two of them."""
    rng = random.Random(23)
    core, texts = said(rng, 35), []
    for _ in range(40):
        own = said(rng, 20)
        texts += [f"{said(rng, 60)} {core} {own} {said(rng, 60)}" for _ in range(2)]
    # The place that matters is the second one of its key.
    last = said(rng, 20)
    texts += [f"{said(rng, 60)} {core} {said(rng, 80)} {core} {last} {said(rng, 9)}", f"{said(rng, 60)} {core} {last} {said(rng, 60)}"]
    got = {(r.doc_id, r.partner_doc_id) for r in substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(i, i ^ 1) for i in range(82)}


def test_joint_windows_of_several_texts_are_those_of_each():
    rng, width = np.random.default_rng(6), 5
    held = []
    for words, n in ((40, 90), (3, 60), (1, 70), (40, 0), (1000, 30)):
        tokens, keys, packed = rng.integers(0, words, n).astype(np.uint64), [], []
        for which, salt in enumerate(substring.SALTS):
            values = (kernels.mix(tokens ^ np.uint64(salt)) & ~np.uint64(3)) | np.uint64(which)
            for left, top, right in substring.compact_windows(values, np.array([0, n]), width).tolist():
                keys.append(int(values[top]))
                packed.append(top << 38 | (top - left) << 19 | (right - top))
        held.append((np.array(keys, np.uint64).view(np.int64), np.array(packed, np.int64)))
    text = np.repeat(np.arange(len(held)), [len(k) for k, _ in held])
    keys, packed, first = substring.joint_windows_of(text, *(np.concatenate(x) for x in zip(*held)), width)
    got = sorted(zip(text[first].tolist(), keys.tolist(), packed.tolist()))
    want = [(i, *pair) for i, x in enumerate(held) for pair in zip(*(v.tolist() for v in substring.joint_windows(*x, width)))]
    assert got == sorted(want) and {i for i, *_ in got} >= {0, 1, 2}


def test_only_stretches_with_wanted_places_are_verified():
    a = np.arange(200, dtype=np.uint32)
    b = np.concatenate([a[:60], 1000 + a[:40], a[100:]])
    every = list(substring.verified(a, b, 20, 0.9))
    assert sorted(x[:2] for x in every) == [(0, 59), (100, 199)]
    assert [x[:2] for x in substring.verified(a, b, 20, 0.9, wanted=[150])] == [(100, 199)]
    assert not list(substring.verified(a, b, 20, 0.9, wanted=[]))
    assert (0, 59) in [x[:2] for x in substring.verified(a, b, 20, 0.9, wanted=[30])]


@pytest.mark.parametrize("kinds", [4, 30, 1000])
def test_links_of_group_by_brute_force(kinds):
    """Every place that has any partner at its key is covered by a link, and all links are verified ones."""
    rng, width = np.random.default_rng(kinds), 12
    stems = [rng.integers(0, kinds, 40).astype(np.uint32) for _ in range(4)]
    tokens = [stems[k % 4].copy() for k in range(16)]
    for t in tokens:
        t[rng.integers(0, 40, 1)] = rng.integers(0, kinds)
        t[rng.permutation(40)[: rng.integers(0, 30)]] += np.uint32(5000)
    owner, top = np.repeat(np.arange(16), 2), np.tile([10, 28], 16)
    keys, packed = np.tile([7, 8], 16), top << 38 | np.tile([10, 16], 16) << 19 | np.tile([16, 11], 16)
    got = list(substring.links_of_group(list(range(16)), [0] * 16, tokens, owner, keys, packed, np.ones(32, bool), width, 0.8))
    assert all(a != b and sim >= 0.8 for a, _, _, b, sim in got)
    for i, j in itertools.permutations(range(16), 2):
        for k in range(2):
            for a, b, c, d in substring.places([(int(packed[2 * i + k]), int(packed[2 * j + k]), 7)], width):
                for start, to, *_ in substring.verified(tokens[i][a : b + 1], tokens[j][c : d + 1], width, 0.8):
                    if a + start <= top[k] <= a + to:
                        assert any(h == i and s <= top[k] <= s + n - 5 for h, s, n, _, _ in got)
    x = tokens[0]
    assert substring.fewest_distinct(x, width) == min(len(set(x[s : s + width].tolist())) for s in range(len(x) - width + 1))


def test_passages_around_open_tops_are_found_beside_likelier_ones():
    """Of a stretch of 80 shingles held by both and 40 with few edits beside it, greedy stretches end before the top."""
    width, base = 46, np.arange(200, dtype=np.uint32)
    other = base.copy()
    other[[100, 106, 112, 118, 124, 130, 136, 142, 148]] += np.uint32(1000)
    other[150:] += np.uint32(5000)
    by = substring.Aligned(base, other, width, 0.8)
    tops = [k for k in range(200) if any(len(np.intersect1d(base[s : s + width], other[s : s + width])) >= 0.8 * len(np.union1d(base[s : s + width], other[s : s + width])) for s in range(max(0, k - width + 1), min(k, 200 - width) + 1))]
    got = by.around(tops)
    assert set(got) == set(tops)
    for top, (start, to, low, high, sim) in got.items():
        x, y = set(base[start : to + 1].tolist()), set(other[low : high + 1].tolist())
        assert start <= top <= to and to - start + 1 >= width and high - low + 1 >= width
        assert sim == len(x & y) / len(x | y) >= 0.8


@pytest.mark.parametrize("seed", range(6))
def test_places_by_member_are_those_of_one_by_one(seed):
    rng, width = np.random.default_rng(seed), 46
    window = lambda top: top << 38 | int(rng.integers(0, min(top, 90) + 1)) << 19 | int(rng.integers(0, 90))
    hits = []
    for n in (1, 0, 40, 7, 90):
        tops = rng.integers(20, 600, n)
        hits.append([(window(int(t)), window(int(t + rng.integers(-14, 14))), 0) for t in tops])
    member = np.repeat(np.arange(5), [len(x) for x in hits])
    a, b = (np.array([x[k] for y in hits for x in y], np.int64) for k in range(2))
    got = sorted(zip(*(v.tolist() for v in substring.places_by_member(member, a, b, width))))
    assert got == sorted((j, *p) for j, x in enumerate(hits) for p in substring.places(x, width))


@pytest.mark.parametrize("kinds", [30, 1000])
def test_bounds_leave_out_no_place_that_a_passage_covers(kinds):
    """All stretches of a that are similar enough to one of b on the middle diagonal, by brute force."""
    rng, width = np.random.default_rng(kinds), 12
    for _ in range(30):
        a = rng.permutation(1000)[:60].astype(np.uint32) if kinds == 1000 else rng.integers(0, kinds, 60).astype(np.uint32)
        b = np.insert(a, rng.integers(0, 60, 3), rng.integers(2000, 3000, 3))
        b[rng.integers(0, 60, 6)] += np.uint32(4000)
        from_a, to_a, from_b, to_b = 4, 55, int(rng.integers(3, 8)), int(rng.integers(50, 60))
        side = substring.Side([1], [0], [b], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), width, 0.8)
        index = substring.Index(side)
        where = np.array([[int(np.flatnonzero(b == x)[0]) if x in b else -1 for x in a]], np.int32)
        alone, strict = np.array([(a == x).sum() == 1 for x in a]), np.array([bool(index.plain[0]) and len(set(a.tolist())) == len(a)])
        held = tuple(np.array([x]) for x in (0, from_a, to_a, from_b, to_b))
        can = dict(substring.hopeful(np.ones(60, bool), alone, where, held, strict, width, 0.8)).get(0, np.zeros(52, bool))
        by = substring.Aligned(a[from_a : to_a + 1], b[from_b : to_b + 1], width, 0.8)
        for start in range(52):
            for to in range(start + width - 1, 52):
                if by.same[start] and by.tried(start, to):
                    assert can[start : to + 1].all()


def test_passages(docs, empty):
    got = {(r.doc_id, r.partner_doc_id) for r in substring.repeated_passages(docs).collect()}
    assert {(7, 8), (8, 7), (5, 4), (4, 5)} <= got
    assert {a for a, _ in got} <= {4, 5, 6, 7, 8}
    assert substring.repeated_passages(empty).count() == 0


def test_batches_hold_few_bytes(spark):
    """A thousand long texts make several batches."""
    Workspace(spark, "batches")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    got = [r.n for r in spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 50000)").mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 50_000_000 and max(got) <= 9_000_000


def test_near(docs, empty):
    got = {r.doc_id: r.component_id for r in near.deduplicate(docs).collect()}
    assert got[6] == got[5] == got[4] == 4 and got[0] == got[1] == 0
    assert all(got[i] == i for i in (2, 3, 7, 8, 9, 10, 11, 12, 13))
    assert near.deduplicate(docs).count() == 15 and near.deduplicate(empty).count() == 0


def test_near_finds_similar_pairs_by_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = said(rng, 150).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 6, 30):
            other = list(words)
            for k in rng.sample(range(150), edits):
                other[k] = said(rng, 1)
            texts.append(" ".join(other))
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(146)}
    sets = [cut(t) for t in texts]
    got = {r.doc_id: r.component_id for r in near.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(len(texts)):
        for j in range(i):
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if similarity >= 0.83:
                assert got[i] == got[j]
            if similarity < 0.05:
                assert got[i] != got[j]


@pytest.mark.parametrize("copies", [12, 45])
def test_near_links_stars_whose_original_comes_last(spark, copies):
    rng = random.Random(21)
    texts, stars = [said(rng, 200) for _ in range(250)], []
    for _ in range(4):
        words, first = said(rng, 200).split(), len(texts)
        for _ in range(copies):
            other = list(words)
            for k in (rng.randint(8, 50), rng.randint(70, 120), rng.randint(140, 190)):
                other[k] = said(rng, 1) + "x"
            texts.append(" ".join(other))
        texts.append(" ".join(words))
        stars.append(range(first, len(texts)))
    got = {r.doc_id: r.component_id for r in near.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [{got[i] for i in star} for star in stars] == [{star[0]} for star in stars]
    assert all(got[i] == i for i in range(250))


def components_of(n, pairs):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def near_against_brute_force(spark, monkeypatch, texts, one_bucket, **limits):
    """(components found, components over all pairs by the weights that the operator used); texts are distinct."""
    signed, sets = near.signatures, near.weighted_sets
    held = []

    def watched(docs, idf, least):
        out = sets(docs, idf, least)
        held.extend(sorted((r.node, np.frombuffer(r.ids, np.uint32), np.frombuffer(r.weights, np.float32)) for r in out.collect()))
        return out

    if one_bucket:
        monkeypatch.setattr(near, "signatures", lambda *a: signed(*a).withColumn("bands", near.F.array(near.F.lit(7).cast("long"))))
    monkeypatch.setattr(near, "weighted_sets", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.deduplicate(docs, **limits).collect()}
    if not one_bucket:
        return got, None
    assert len(held) == len(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near.weighted_jaccard(*held[i][1:], *held[j][1:]) >= 0.8]
    return [got[i] for i in range(len(texts))], components_of(len(texts), pairs)


def test_near_splits_one_large_bucket_by_brute_force(spark, monkeypatch):
    """Texts that share a long passage, all in one bucket; every second is its forerunner with a seventh more."""
    rng = random.Random(12)
    passage, texts = said(rng, 400), []
    for i in range(40):
        own = said(rng, rng.choice((38, 42, 46)))
        texts += [passage + " " + own, passage + " " + own + " " + said(rng, 31)]
    got, want = near_against_brute_force(spark, monkeypatch, texts, True)
    assert 10 < len(set(want)) <= 40 and got == want


@pytest.mark.parametrize("dense", [near.DENSE, 0])
def test_near_links_what_only_some_members_are_similar_to(spark, monkeypatch, dense):
    """Chains of edits, and groups of 61 whose smallest id is similar to a few of them only, in one bucket."""
    rng = random.Random(31)
    texts = []
    for _ in range(3):  # each link of a chain has one more edit than the one before
        words = said(rng, 160).split()
        for k in range(12):
            words[5 + 12 * k] = said(rng, 1) + "y"
            texts.append(" ".join(words))
    for _ in range(2):
        words = said(rng, 200).split()
        far = list(words)
        for k in (20, 60, 100, 140, 180):
            far[k] = said(rng, 1) + "z"
        texts.append(" ".join(far))
        for _ in range(60):
            other = list(words)
            for k in rng.sample(range(200), rng.choice((1, 2, 3))):
                other[k] = said(rng, 1) + "x"
            texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    got, want = near_against_brute_force(spark, monkeypatch, texts, True, dense=dense)
    assert got == want and 5 < len(set(want)) < 100


def test_near_contracts_a_large_group_before_it_pairs_all(spark, monkeypatch):
    """350 near copies of one text, in one bucket, whose smallest id is similar to none of them."""
    rng = random.Random(5)
    words, texts = said(rng, 200).split(), []
    for n in (14, *rng.choices((1, 2, 3, 4), k=350)):
        other = list(words)
        for k in rng.sample(range(0, 200, 5), n):
            other[k] = said(rng, 1) + "x"
        texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))
    made, meetings = [], near.meetings

    def counted(*a):
        out = meetings(*a)
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "meetings", counted)
    got, want = near_against_brute_force(spark, monkeypatch, texts, True)
    pairs = len(texts) * (len(texts) - 1) // 2
    assert got == want and len(made) > 1 and sum(made) < pairs / 4


def test_near_recall_by_brute_force(spark, monkeypatch):
    """Of pairs p and m similar to each other, where a third text with the smallest id is similar to p only."""
    rng = random.Random(77)
    texts, pairs = [], []
    for _ in range(60):
        words = said(rng, 240).split()
        first, other = list(words), list(words)
        for k in rng.sample(range(0, 120), 3):
            first[k] = said(rng, 1) + "x"
        for k in rng.sample(range(120, 240), 3):
            other[k] = said(rng, 1) + "y"
        pairs.append((len(texts) + 1, len(texts) + 2))
        texts += [" ".join(first), " ".join(words), " ".join(other)]
    got, _ = near_against_brute_force(spark, monkeypatch, texts, False)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 44, 400).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    sample = near.Sampler(2000)
    x, y = (sample(ids, np.log(w).astype(np.float32), np.array([0, 400]))[0] for w in (a, b))
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = graph.components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert all(low[r.node] == r.root for r in got)
    assert {r.node for r in got} == {x for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("block", [17, 3, 2000])
def test_embeddings_by_brute_force(spark, block):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    vectors = [*base, *(base[:40] + rng.normal(scale=0.1, size=(40, 16)) * rng.uniform(0, 1, (40, 1))), *base[:3]]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [1.0, None], 1), (505, [], 0)]
    got = {r.vec_id: r for r in embed.link(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near_ = (m @ m.T >= 0.98) & (label[:, None] == label[None, :])
    for i in range(len(rows)):
        assert got[i].n_links == near_[i].sum() - 1
    low = np.arange(len(rows))
    for _ in range(50):
        low = np.where(near_, low[None, :], 10**6).min(axis=1)
    assert [got[i].component_id for i in range(len(rows))] == low.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd)
    assert embed.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_sentencepiece_exact(docs, rows, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), spm.load(path), random.Random(1)
    pieces = list(model.ids)
    for n in range(3000):
        text = "".join(rng.choice("abtheing  e▁\n\té日😀.") for _ in range(rng.randint(0, 30))) if n % 2 else "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace("▁", " ")
        ids = sp.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == sp.decode(ids)
    want = sorted((r[0], len(ids := sp.encode(r[1] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, spm.encode_documents(docs, path).collect())) == want
    assert spm.encode_documents(empty, path).count() == 0


def test_packing_is_whole_and_gapless(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, P.path("byte_bpe_50k.tiktoken"), size=128).collect()
    exact = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (a, n) in enumerate(packing.cut(len(ids), 128)):
            want[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\n" * 1_200_000, ("a" + " " * 99_990) * 3, "\u3000" * 200_000 + "b", "é" * 300_000])
def test_packing_encodes_long_runs(text):
    encode = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_packing_is_near_the_floor(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, said(rng, rng.choice((20, 120, 300, 700)))) for i in range(400)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).collect()
    floor = -(-sum(r.length for r in got) // 2048)
    assert floor <= len({r.sequence_id for r in got}) <= 1.03 * floor + 1


def test_urls(spark):
    cases = {
        "https://WWW.Example.com/en/a?x=1": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://m.example.com/en/9#t": ("m.example.com", "/en/9", "example.com/en/", "block"),
        "http://example.com": ("example.com", "", None, None), "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "http://notnet/es/": ("notnet", "/es/", None, None),
        "http://a.com/de": ("a.com", "/de", "com/", "allow"), "no scheme": ("", "", None, None), "x?u=http://a.net/fr/1": ("a.net", "/fr/1", "net/fr/", "block"), None: ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    for r in urls.filter_urls(pages).collect():
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    model = urls.UrlModel()
    scores = model.score(pa.array(["best-casino.biz /poker/bonus", "www.library.org /docs/guide"]))
    assert scores[0] > 0.5 > scores[1]


def test_ordinal_orders_four_grades():
    rng = random.Random(3)
    sample = [(i, "en", " ".join(rng.choice(WORDS) if rng.random() > g / 4 else "bad" + rng.choice("xyz") for _ in range(60)), float(3 - g)) for i in range(400) for g in [rng.randint(0, 3)]]
    model = ordinal.CumulativeLink(sample)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(kernels.Block(*kernels.text_buffers(pa.array([s[2] for s in sample]))))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(1), [s[3] for s in sample])[0, 1] > 0.85


def test_models_on_held_out(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold a few dozen toxic labels, too few to learn the words from
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = [r for r in queries.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in toxic]) > 0.93
    good = [r for r in queries.op10_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.kept == bool(labels[r.doc_id].quality) for r in good]) > 0.93


def test_toxicity_scores_by_hand():
    """The network's value for each text alone, by loops; a score doesn't depend on the texts beside it."""
    texts = ["alpha beta", "gamma", "delta epsilon zeta eta", "", "eta theta alpha", "unknown words only", "a"]
    vocabulary = np.unique(toxicity.features(kernels.Block(*kernels.text_buffers(pa.array(texts[:5]))))[0])
    net = toxicity.Cnn(vocabulary[vocabulary != 0])
    hashes, first = toxicity.features(kernels.Block(*kernels.text_buffers(pa.array(texts))))
    rows = net.rows(hashes)
    got = net.scores(rows, first)
    for i in range(len(texts)):
        own = [sum(net.table[r] for r in row) for row in rows[first[i] : first[i + 1]].tolist()]
        own = [*own, *[np.zeros(net.table.shape[1], np.float32)] * 4]
        pooled = []
        for filters, bias in zip(net.filters, net.biases):
            values = [sum(own[k + j] @ filters[j] for j in range(len(filters))) + bias for k in range(len(own) - 2)]
            pooled += np.maximum(np.max(values, axis=0), 0).tolist()
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(np.dot(pooled, net.out) + net.bias))), abs=1e-6)


def test_ordinal_tails_by_hand(spark):
    """Each word's four features, looked up one by one."""
    rng = random.Random(9)
    sample = [(i, "en", " ".join(rng.choice(("good", "bad", "fine")[g : g + 2] + ("x",)) for _ in range(20)), float(g)) for i in range(60) for g in (0, 1)]
    model = ordinal.CumulativeLink(sample, epochs=2)
    for text in ("good bad bad", "", "x", "Good  9ine\tx x x"):
        block = kernels.Block(*kernels.text_buffers(pa.array([text])))
        buckets, _ = ordinal.features(block)
        raw = sum(model.weights[b] for row in buckets.tolist() for b in row) / max(1, len(text.split()))
        want = [1 / (1 + np.exp(-(raw - t))) for t in model.thresholds]
        assert np.allclose(model.tails(block)[0], want)


def test_mcd_finds_the_centre_despite_outliers(spark):
    rng = np.random.default_rng(8)
    p = len(quality_rules.STATS)
    good = rng.normal(size=(600, p)) * 0.3 + 1.0
    bad = rng.normal(size=(100, p)) * 0.3 + 9.0
    rows = spark.createDataFrame([("g", *map(float, r)) for r in (*good, *bad)], ["g", *quality_rules.STATS])
    fit = quality_rules.robust_fits(spark, rows, Workspace(spark, "test")).first()
    assert np.abs(np.array(fit["centre"]) - good.mean(axis=0)).max() < 0.1
    inverse = np.array(fit["inverse"]).reshape(p, p)
    d2 = lambda m: np.einsum("ij,jk,ik->i", m - fit["centre"], inverse, m - fit["centre"])
    assert np.quantile(d2(good), 0.95) < np.quantile(d2(bad), 0.01)


def test_kept_handles_nulls_and_constant_groups(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, words, None, None) for i in range(60)] + [(100, None, "en", "s"), (101, "", None, "s"), (102, "a " * 60, "en", None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in (100, 101, 102)) and len(got) == 63


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    one = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and one(got) == one(want)


def test_too_many_labels(spark, docs):
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id as int) as quality")
    with pytest.raises(ValueError, match="over 64"):
        ordinal.fit(docs, labels)


def test_urls_of_any_kind(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "no scheme"), (4, "http://" + "a" * 200_000 + ".com/x"), (5, "HTTP://WWW.Example.COM/en/é?q#f"), (6, "x://net/es/"), (7, "http://h/" + "é" * 100_000)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and got[3].host == ""
    assert got[4].rule == "com/" and got[5].rule == "www.example.com/en/" and got[6].verdict == "block" and got[7].host == "h"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).count() == len(rows)


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, none).count() == 15
    assert {r.kept for r in ordinal.grade(docs, none).collect()} == {True}
