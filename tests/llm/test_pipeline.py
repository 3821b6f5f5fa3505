"""The corpus pipeline: stage by stage against the operators' own results."""

import collections

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert 0 < len(ids) < 200


def test_repeated_rows_leave_one(spark, sf):
    def text(seed, n=120):
        return " ".join(f"word{(seed * 7919 + k * k * 31 + k) % 9973}" for k in range(n))

    near_7 = text(7).replace(text(7).split()[60], "other")
    # A repeated row; a doc_id with a copy of another's text and one of its own; and one that holds two near copies.
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (4, text(2)), (4, text(4)), (7, near_7), (7, text(7)), (9, text(7)), (None, text(2)), (None, text(2))]
    rows += [(20 + i, text(20 + i)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, sf)
    got = sorted((r.doc_id or 0, r.text) for r in left.collect())
    sevens = [t for i, t in got if i == 7]
    assert len(sevens) == 1 and sevens[0] in (near_7, text(7))
    assert [x for x in got if x[0] != 7] == sorted([(1, text(1)), (2, text(2)), (4, text(4)), (0, text(2)), (0, text(2)), *rows[10:]])
    cut = corpus_pipeline.cut_repeats(spark, left.where("doc_id is not null"), sf)
    assert {r.doc_id: r.text for r in cut.collect()}[1] == text(1)


SCHEMA = "doc_id long, text string, _n long, _h1 string, _kept string, h1 string, n_copies long, id string, source string, n_chars long"


def words(seed, n=120):
    return " ".join(f"word{(seed * 7919 + k * k * 31 + k) % 9973}" for k in range(n))


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Nulls, empty and long texts, repeated rows and ids, copies, near copies, shared passages; clashing columns, no lang."""
    passage = words(900, 60)
    texts = [(1, words(1)), (1, words(1)), (2, words(2)), (4, words(2)), (4, words(4)), (7, words(7)), (8, words(7).replace(words(7).split()[60], "other")), (None, words(2)), (None, None), (10, None), (11, ""), (12, " "), (13, words(13, 4000))]
    texts += [(20 + i, f"{words(20 + i, 70)} {passage} {words(50 + i, 70)}") for i in range(3)] + [(40, "é日本 " * 90 + words(40))]
    texts += [(60 + i, words(60 + i, 200)) for i in range(25)]
    return spark.createDataFrame([(i, t, 1, "x", "x", "x", 2, "x", "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_run_by_brute_force(spark, sf, odd):
    """Each stage's rows from its own input, worked out one by one."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from foliant.llm import kernels, near, ordinal, toxicity

    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    block = lambda t: kernels.Block(*kernels.text_buffers(pa.array([t or ""])))

    docs = odd
    model = toxicity.fit(docs, labels)
    left = stages["toxicity"](spark, docs, sf).cache()
    want = collections.Counter(tuple(r) for r in docs.collect() if model.score(block(r.text))[0] < 0.5)
    assert rows_of(left) == want and left.columns == docs.columns

    docs, model = left, ordinal.fit(left, labels)
    left = stages["quality classifier"](spark, docs, sf).cache()
    want = collections.Counter(tuple(r) for r in docs.collect() if not len(model.thresholds) or model.tails(block(r.text))[0, -1] >= 0.5)
    assert rows_of(left) == want

    docs = left
    left = stages["MinHash near-dedup"](spark, docs, sf).cache()
    rows = docs.collect()
    own = sorted({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None})
    texts = sorted({t for _, t in own})
    idf = near.frequency_table(docs)
    sets = []
    for t in texts:
        ids, counts, _ = near.weighted_shingles(block(t))
        sets.append((ids, idf[(ids & np.uint64((1 << near.DF_BITS) - 1)).astype(int)] * counts))
    root = {t: t for t in texts}
    for _ in texts:
        for i, a in enumerate(texts):
            for j in range(i):
                if len(sets[i][0]) and len(sets[j][0]) and near.weighted_jaccard(*sets[i], *sets[j]) >= 0.8:
                    root[a] = root[texts[j]] = min(root[a], root[texts[j]])
    groups = collections.defaultdict(list)
    for i, t in own:
        groups[root[t]].append(i)
    kept = [r for r in left.collect()]
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(min(g) for g in groups.values())
    assert all((r.doc_id, r.text or "") in own for r in kept if r.doc_id is not None)
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in rows)

    docs = left
    left = stages["suffix-array dedup"](spark, docs, sf).cache()
    size = corpus_pipeline.PASSAGE_BYTES
    rows = docs.collect()
    data = [(r.text or "").encode() for r in rows]
    seen = collections.Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    want = collections.Counter()
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = True
        text = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore")
        want[tuple({**r.asDict(), "text": r.text if r.text is None or not gone.any() else text}.values())] += 1
    assert rows_of(left) == want
    assert any(seen[d[k : k + size]] > 1 for d in data for k in range(len(d) - size + 1))

    packed = stages["best-fit packing"](spark, left, sf).collect()
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = collections.Counter()
    for r in left.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % 2048 or 2048
        for n, start in enumerate([0, *range(cut, len(ids), 2048)]):
            own = ids[start : cut if n == 0 else start + 2048]
            pieces[r.doc_id, n, start, len(own), __import__("zlib").crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    filled = collections.defaultdict(list)
    for r in packed:
        filled[r.sequence_id].append((r.offset, r.length))
    for held in filled.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 2048


def test_stages_on_an_empty_table(spark, sf, odd):
    docs = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
