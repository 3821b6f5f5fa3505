"""Edit fingerprints, Merkle manifests and Yinyang clusters against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import fingerprints, merkle, queries, yinyang
from foliant.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, at int, guest string"


def said(rng, n):
    return "".join(rng.choice("etaoin shrdlu é日\n") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, one source with most rows; clashing columns."""
    rng = random.Random(8)
    out = [(i, said(rng, rng.choice([0, 1, 2, 9, 300, 900])), rng.choice(["en", None]), rng.choice(["hot"] * 9 + ["b", "", None, "é"]), rng.choice([None, 5])) for i in range(100, 1000)]
    out += [(7, said(rng, 40_000), "en", "b", 40_000), (8, None, None, None, None), (9, "", "fr", "lone", 0), (-3, "x\ny", "fr", "b", 3)]
    out += [out[0], out[0], (out[1][0], "another text", "en", "hot", 1), (None, "no id\n", "en", "hot", 6), (None, None, None, None, None)]
    return [(*r, "t", 1, 2, "g") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def slow_walk(points, which, begin=0):
    """When a walk reaches each character and the end, one step after the other."""
    classes, _ = fingerprints.classes_of(points)
    step, out = begin, []
    for c in classes:
        out.append(step)
        while True:
            goes = int(fingerprints.MASKS[which][c]) >> (step % fingerprints.PERIOD) & 1
            step += 1
            if goes:
                break
    return [*out, step]


def test_walks(monkeypatch):
    rng = random.Random(1)
    points = [fingerprints.code_points(said(rng, n)) for n in (0, 1, 2, 31, 32, 33, 700, 3000, 0, 5)] + [np.full(4000, 97, np.uint32)]
    for part in (1 << 17, 500):
        monkeypatch.setattr(fingerprints, "PART", part)
        walked = fingerprints.Walked(points)
        for which, reached in enumerate(walked.reached):
            assert [r.tolist() for r in reached] == [slow_walk(p, which) for p in points]
    head = [len(p) - len(p) // 2 for p in points]
    tail = [q[: len(p) // 2] for p, q in zip(points, points[1:] + points[:1])]
    whole = [np.concatenate([p[:h], t]) for p, h, t in zip(points, head, tail)]
    assert walked.joined(head, tail) == fingerprints.Walked(whole).fingerprints()


def test_likeness_by_all_steps():
    """Sampled likeness is near the share of all steps that agree, also for texts of different lengths."""
    rng = random.Random(3)
    base = said(rng, 3000)
    for other in (base, base[:1500] + "zz" + base[1500:], base[:2000], base[:1400] + said(rng, 1600), said(rng, 500)):
        points = [fingerprints.code_points(t) for t in (base, other)]
        one, two = fingerprints.Walked(points).fingerprints()
        best = 0.0
        for which in range(fingerprints.WALKS):
            written = []
            for p in points:
                reached, (_, symbols) = slow_walk(p, which), fingerprints.classes_of(p)
                written.append(np.repeat(symbols, np.diff(reached)))
            n = min(map(len, written))
            best = max(best, float((written[0][:n] == written[1][:n]).sum()) / max(map(len, written)))
        assert abs(fingerprints.likeness(one, two) - best) < 0.12
        assert fingerprints.likeness(one, two) == fingerprints.likeness(two, one)
        assert fingerprints.parsed(fingerprints.shown(one)) == one


def test_edits_of_documents(spark, docs, rows):
    got = sorted((tuple(r) for r in fingerprints.fingerprint_edits(docs).collect()), key=str)
    xx = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    order = sorted(((r[0], xx[r[1] or ""], r[1] or "") for r in rows if r[0] is not None))
    pairs = [(i, t, n[2]) for (i, _, t), n in zip(order, order[1:] + order[:1])] + [(None, r[1] or "", "") for r in rows if r[0] is None]
    prints = lambda t: fingerprints.Walked([fingerprints.code_points(t)]).fingerprints()[0]
    want = []
    for i, text, after in pairs:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = prints(text), prints(edited), prints(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.shown(a), fingerprints.shown(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert got == sorted(want, key=str)
    long = [r for r in got if r[1] >= 300]
    assert sum(r[5] > r[6] for r in long) >= len(long) - 3  # but for repeated rows


def test_edits_of_few_rows(spark, docs):
    assert fingerprints.fingerprint_edits(docs.where("false")).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]


def test_edit_distance():
    def slow(a, b):
        held = list(range(len(b) + 1))
        for i, x in enumerate(a):
            now = [i + 1]
            for j, y in enumerate(b):
                now.append(min(held[j] + (x != y), held[j + 1] + 1, now[j] + 1))
            held = now
        return held[-1]

    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(30))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        exact = slow(a, b)
        one, two = np.array(a, np.uint32), np.array(b, np.uint32)
        for most in {exact, exact + 3, max(0, exact - 1)}:
            assert fingerprints.edit_distance(one, two, most) == (exact if exact <= most else None)
            assert fingerprints.within(one, two, most) == (exact <= most)


def test_near_texts(spark):
    rng = random.Random(5)
    rows, groups = [], []
    for g in range(12):
        base = said(rng, 1500)
        own = []
        for _ in range(5):
            at = rng.randrange(1400)
            own.append(base[:at] + said(rng, 3) + base[at + rng.randrange(4) :])
        groups.append([len(rows) + k for k in range(7)])
        rows += [base, base, *own]
    table = [(i, t, "x") for i, t in enumerate(rows)] + [(None, rows[0], "x"), (900, None, "x"), (901, "", "x"), (902, "short", "x")]
    got = {r.doc_id: r for r in fingerprints.near_texts(spark.createDataFrame(table, "doc_id long, text string, key string")).collect()}
    found = sum(got[i].component_id == own[0] for own in groups for i in own)
    assert found >= 0.95 * len(rows)
    assert all(got[i].component_id in own for own in groups for i in own)
    assert got[1].n_copies >= 2 and not got[1].kept and got[0].kept
    assert got[901].component_id == 900 and got[902].kept and got[None].kept
    assert fingerprints.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(nodes):
    """The root, and for each leaf the siblings on its way up."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for i in range(0, len(nodes), 3):
            three = nodes[i : i + 3]
            for k in range(len(three)):
                for leaf in under[i + k]:
                    paths[leaf].append(("".join(three[:k]), "".join(three[k + 1 :])))
            above.append(H(*three))
            held.append(sum(under[i : i + 3], []))
        nodes, under = above, held
    return nodes[0], paths


def test_manifest(spark, docs, rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(part, (r[0], r[3], r[2], r[4], text)))
    trees: dict = {}
    for r in rows:
        touched = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].replace("\n", "")) if touched else leaf(r, r[1]), r[0]))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    done = [(sorted(trees[k], key=lambda x: x[:4]), slow_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:4])])) for k in names]
    root, upper = slow_tree([sub for _, (sub, _) in done])
    want = []
    for (leaves, (sub, paths)), up in zip(done, upper):
        for (_, _, own, now, doc_id), path in zip(leaves, paths):
            for a, b in path + up:
                now = H(a, now, b)
            want.append((doc_id, own, sub, root, H(*(x for p in path + up for x in p)), now, now == root))
    got = [tuple(r) for r in merkle.verify_documents(docs).collect()]
    assert len(max(trees.values(), key=len)) > 600 and sorted(got, key=str) == sorted(want, key=str)
    assert 0 < sum(r[6] for r in got) < len(got)
    assert merkle.verify_documents(docs.where("false")).count() == 0


def test_store_of_several_tables(spark, monkeypatch):
    """Proofs that cross runs at more than one height."""
    monkeypatch.setattr(merkle, "SPAN", 2)
    monkeypatch.setattr(merkle, "RUN", 9)
    work = Workspace(spark, "merkle-test")
    leaves = spark.range(400).select(F.lit("=a").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(None).cast("string").alias("other"))
    got = {r.doc_id: r for r in merkle.folded(merkle.manifest(work, leaves)).collect()}
    root, paths = slow_tree([H(str(i)) for i in range(400)])
    assert all(r.root == r.subroot == root and r.verified for r in got.values())
    assert all(got[i].proof_sha256 == H(*(x for p in paths[i] for x in p)) for i in range(400))


def slow_clusters(ids, x, k=40, rounds=5):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:k]
    centroids = [[int(v) for v in x[i]] for i in order]
    for turn in range(rounds + 1):
        apart = [[sum((int(a) - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        own = [min(range(len(centroids)), key=lambda c: (d[c], c)) for d in apart]
        if turn < rounds:
            for c in range(len(centroids)):
                held = [v for v, o in zip(x, own) if o == c]
                if held:
                    centroids[c] = [sum(int(v[j]) for v in held) // len(held) for j in range(x.shape[1])]
    return own, [d[o] for d, o in zip(apart, own)], centroids


@pytest.mark.parametrize("spread", [1.0, 0.02, 1e7])
def test_clusters(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    v = (centres[rng.integers(0, 60, 400)] + rng.normal(size=(400, 64)) * 0.1) * spread
    v[50:60] = v[49]
    rows = [(i, [float(a) for a in r], "x", 1, [0.0]) for i, r in enumerate(v)]
    rows += [rows[3], (500, None, "x", 1, None), (501, [1.0] * 63, "x", 1, None), (502, [1.0] * 63 + [None], "x", 1, None), (503, [1.0] * 63 + [float("nan")], "x", 1, None)]
    rows += [(504, [1.0] * 63 + [float("-inf")], "x", 1, None), (None, [1.0] * 64, "x", 1, None), (505, [], "x", 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, x int, lower array<double>").repartition(3)
    got = yinyang.cluster(df).collect()
    kept = [r for r in rows[:401]]
    x = np.clip(np.floor(256 * np.array([r[1] for r in kept])), -yinyang.MOST, yinyang.MOST).astype(np.int64)
    own, apart, centroids = slow_clusters([r[0] for r in kept], x)
    total, digest = sum(apart), lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    inertia = [sum(a for a, o in zip(apart, own) if o == c) for c in range(40)]
    fits = lambda n: n if n < 1 << 63 else None
    want = [(r[0], o, a, fits(inertia[o]), fits(total), digest(o)) for r, o, a in zip(kept, own, apart)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert yinyang.cluster(spark.createDataFrame([], schema)).count() == 0
    assert yinyang.cluster(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    got = yinyang.cluster(spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], schema)).collect()
    assert {r.distance for r in got} == {0} and len({r.cluster for r in got}) == 3


def test_filters_spare_comparisons(monkeypatch):
    """What the bounds pass over is never nearer: the same clusters as without them, from fewer distances."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] * 200 + rng.normal(size=(3000, 64)) * 20).astype(np.int64)
    centroids, before, state, counted = x[:40].copy(), None, None, []
    groups = yinyang.centroid_groups(centroids)
    plain = yinyang.squared_distances
    monkeypatch.setattr(yinyang, "squared_distances", lambda a, c: counted.append(len(a) * len(c)) or plain(a, c))
    for _ in range(6):
        counted.clear()
        move = yinyang.Move(centroids, groups, before)
        state = move.first(x) if state is None else move.next(x, *state)
        exact = plain(x, centroids)
        assert (state[0] == exact.argmin(axis=1)).all()
        assert (np.sqrt(exact.min(axis=1)) <= state[1] * (1 + 1e-9) + 1e-6).all()
        before, centroids = centroids, centroids.copy()
        for c in range(40):
            if (state[0] == c).any():
                centroids[c] = x[state[0] == c].sum(axis=0) // (state[0] == c).sum()
    assert sum(counted) < 0.5 * exact.size


def test_queries_are_registered():
    assert {"op11_edit_fingerprints", "op12_merkle_manifest", "op13_yinyang_clusters"} <= set(queries.QUERIES)


def test_url_model_tells_names_and_not_domains(spark):
    """Fitted on one placing of each name, it knows them under other domains, prefixes and paths."""
    import re

    import pyarrow as pa

    from foliant.llm import urls

    keys = lambda rows: pa.array([" ".join((m[1].lower(), m[2])) for u, _ in rows for m in [re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)]])
    fitted, held = urls.labelled_urls(turns=(0,)), urls.labelled_urls(turns=(1,))
    said = urls.UrlModel(fitted).score(keys(held)) >= 0.5
    assert (said == np.array([y for _, y in held], bool)).mean() > 0.97
    ends = [{u.split("/")[2].rsplit(".", 1)[1] for u, y in urls.LABELLED if y == label} for label in (0, 1)]
    assert ends[0] == ends[1]
    rows = [(1, "https://www.casino-win.example.org/de/7"), (2, "https://blog.spam-farm.example.org/fr/"), (3, "https://blog.meadow.example.org/de/7"), (4, "https://www.brook.example.org/fr/")]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_mcd_settles_at_the_lesser_determinant(spark):
    """From either start alone, longer or shorter, no fit has a lesser determinant; its centre isn't drawn by a third of far rows."""
    from foliant.llm import quality_rules as Q

    rng = np.random.default_rng(3)
    p = len(Q.STATS)
    good, bad = rng.normal(size=(700, p)) * 0.3 + 1.0, rng.normal(size=(210, p)) * 0.05 + np.linspace(4, 9, p)
    rows = spark.createDataFrame([(g, *map(float, r)) for g in ("a", "b") for r in (*good, *(bad if g == "b" else []))], ["g", *Q.STATS])
    fits = {r.g: r for r in Q.robust_fits(spark, rows, Workspace(spark, "settled")).collect()}
    longer = {r.g: r for r in Q.robust_fits(spark, rows, Workspace(spark, "settled"), most_steps=40).collect()}
    shorter = {r.g: r for r in Q.robust_fits(spark, rows, Workspace(spark, "settled"), most_steps=1).collect()}
    for g in "ab":
        assert abs(fits[g].logdet - longer[g].logdet) < 1e-5 and fits[g].logdet <= shorter[g].logdet + 1e-6
        assert np.abs(np.array(fits[g].centre) - good.mean(axis=0)).max() < 0.1
    inverse = np.array(fits["b"].inverse).reshape(p, p)
    cov = np.linalg.inv(inverse)
    floors = np.square([f for _, f in Q.STATS.values()])
    spread = np.sqrt((np.diag(cov) - floors) / good.var(axis=0))
    assert (0.6 < spread).all() and (spread < 1.6).all()


def test_cells_of_further_kinds_lose_no_link(spark, monkeypatch):
    """Where no centres are fitted, drawn ones part the vectors as exactly."""
    from foliant.llm import embed

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    v = base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 8)) * 0.05
    df = spark.createDataFrame([(i, [float(a) for a in r], 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embed, "KINDS", 0)
    got = {r.vec_id: r.n_links for r in embed.link(df, block=20).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert [got[i] for i in range(400)] == want.tolist() and want.max() > 3
