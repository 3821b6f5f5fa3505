"""Merkle manifests of datasets: a tree for each group of rows, a tree over their roots, and a proof for every row.

Nodes lie in an external store, Parquet partitioned by level, and are named by coordinates: group, level and number within
it. Leaves are numbered by a range sort, so that a group of any size is dealt over many tasks. A run is a subtree of
SPAN levels; runs are sorted by coordinate and stream through tasks that hold one run at a time: upwards to write the
levels above, of which the last is read as the next leaves, downwards to merge a run's nodes with the proof of its top,
level by level, until every leaf has its siblings. Between two runs only their tops travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from foliant.workspace import Workspace

FANOUT, SPAN = 3, 6
RUN = FANOUT**SPAN
_PROOF = ["left", "right", "subroot", "root"]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """sha256 over each field's UTF-8 byte count, a colon and its value; `-` for null."""
    texts = [f.cast("string") for f in fields]
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*said), 256)


def numbered(work: Workspace, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with idx, their place from 0 within `tree` by `order`, and size, the rows of that tree.

    Partitions of a range sort follow each other, so a row's place is its place in its partition and the rows of its
    tree in earlier ones; of these there is one count for each partition and tree.
    """
    held = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    held = work.put(held.withColumn("seq", F.monotonically_increasing_id()), f"{name}-sorted").withColumn("part", F.shiftright("seq", 33))
    counts = work.put(held.groupBy("part", "tree").agg(F.count("*").alias("n"), F.min("seq").alias("low")), f"{name}-counts")
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "tree", (before - F.col("low")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return held.join(starts, ["part", "tree"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _by_run(nodes: DataFrame, *order: str | Column) -> DataFrame:
    return nodes.repartition("tree", "run").sortWithinPartitions("tree", "run", *order)


_NODE = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("level", pa.int32())])


def raised(nodes: DataFrame, level: int) -> DataFrame:
    """The SPAN levels above nodes of `level`, less where a tree ends before."""

    def climb(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (tree, run), held in groupby(rows, lambda r: r[:2]):
            held = list(held)  # a run
            digests, size, start = [r[4] for r in held], held[0][3], run * RUN
            for up in range(1, SPAN + 1):
                if size == 1:
                    break
                digests = [digest(*digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
                size, start = -(-size // FANOUT), start // FANOUT
                for i, d in enumerate(digests):
                    yield tree, start + i, size, d, level + up

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emitted(climb(_rows(batches, ["tree", "run", "idx", "size", "digest"])), _NODE)

    dealt = nodes.where("size > 1").select("tree", F.expr(f"idx div {RUN}").alias("run"), "idx", "size", "digest")
    return _by_run(dealt, "idx").mapInArrow(run, "tree string, idx long, size long, digest string, level int")


def build(work: Workspace, leaves: DataFrame, name: str) -> list[DataFrame]:
    """The node store above leaves (tree, idx, size, digest), SPAN levels a table, partitioned by level."""
    store: list[DataFrame] = []
    nodes, level = leaves.select("tree", "idx", "size", "digest"), 0
    while True:
        store.append(work.put(raised(nodes, level), f"{name}-nodes", by="level"))
        level += SPAN
        nodes = store[-1].where(F.col("level") == level).select("tree", "idx", "size", "digest")
        if nodes.where("size > 1").isEmpty():
            return store


def subroots(leaves: DataFrame, store: list[DataFrame]) -> DataFrame:
    """(tree, digest, level): the one node that remains of each tree."""
    out = leaves.where("size = 1").select("tree", "digest", F.lit(0).alias("level"))
    for nodes in store:
        out = out.unionByName(nodes.where("size = 1").select("tree", "digest", "level"))
    return out


def proven(leaves: DataFrame, inner: DataFrame, crowns: DataFrame, extra: list[str], level: int) -> DataFrame:
    """Each leaf (tree, idx, size, digest and what is in `extra`) with its siblings, nearest first, left and right apart.

    inner are the nodes between the leaves and their runs' tops; crowns have the proof of each run's top.
    """
    strings = pa.list_(pa.string())
    types = {"tree": pa.string(), "run": pa.int64(), "level": pa.int32(), "idx": pa.int64(), "size": pa.int64(), "digest": pa.string(), "left": strings, "right": strings}
    types |= {"subroot": pa.string(), "root": pa.string(), **{n: pa.int64() if n == "doc_id" else pa.string() for n in extra}}
    names = list(types)
    schema = pa.schema([(n, types[n]) for n in ("tree", "idx", "digest", *_PROOF, *extra)])

    def descend(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, held in groupby(rows, lambda r: r[:2]):
            proofs: list[tuple[list[str], list[str]]] = []
            for at, nodes in groupby(held, lambda r: r[2]):
                nodes = list(nodes)  # a level of a run
                if not proofs:  # the crown comes first
                    proofs, subroot, root = [(nodes[0][6], nodes[0][7])], nodes[0][8], nodes[0][9]
                    continue
                now = []
                for i, node in enumerate(nodes):
                    left, right = proofs[i // FANOUT]
                    if node[4] > 1:
                        first = i - i % FANOUT
                        left = ["".join(n[5] for n in nodes[first:i]), *left]
                        right = ["".join(n[5] for n in nodes[i + 1 : first + FANOUT]), *right]
                    if at == level:
                        yield (node[0], node[3], node[5], left, right, subroot, root, *node[10:])
                    now.append((left, right))
                proofs = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emitted(descend(_rows(batches, names)), schema)

    spark_type = {n: from_arrow_type(t).simpleString() for n, t in types.items()}
    filled = lambda df, *own: df.select(*(c if c in own else F.lit(None).cast(spark_type[c]).alias(c) for c in names))
    own = ("tree", "run", "level", "idx", "size", "digest")
    lowest = leaves.withColumns({"level": F.lit(level), "run": F.expr(f"idx div {RUN}")})
    width = F.pow(F.lit(FANOUT), F.lit(level + SPAN) - F.col("level")).cast("long")
    middle = inner.where((F.col("size") > 1) & (F.col("level") < level + SPAN)).withColumn("run", F.floor(F.col("idx") / width))
    tops = crowns.withColumn("level", F.lit(level + SPAN))
    union = filled(lowest, *own, *extra).unionByName(filled(middle, *own)).unionByName(filled(tops, "tree", "run", "level", *_PROOF))
    return _by_run(union, F.desc("level"), "idx").mapInArrow(run, ", ".join(f"{f.name} {spark_type[f.name]}" for f in schema))


def prove(work: Workspace, leaves: DataFrame, store: list[DataFrame], tops: DataFrame, extra: list[str], name: str) -> DataFrame:
    """Each leaf with the siblings on its way up, within its tree and on from its subroot.

    tops has (tree, level, left, right, subroot, root): the subroot's level and its own proof.
    """
    above: DataFrame | None = None
    for i in reversed(range(len(store))):
        level = i * SPAN
        ends = tops.where((F.col("level") <= level + SPAN) & ((F.col("level") > level) | F.lit(i == 0)))
        crowns = ends.select("tree", F.lit(0).cast("long").alias("run"), *_PROOF)
        if above is not None:
            crowns = crowns.unionByName(above.select("tree", F.col("idx").alias("run"), *_PROOF))
        lowest = leaves if i == 0 else store[i - 1].where((F.col("level") == level) & (F.col("size") > 1)).select("tree", "idx", "size", "digest")
        out = proven(lowest, store[i], crowns, extra if i == 0 else [], level)
        if i == 0:
            return out
        above = work.put(out, f"{name}-proofs")
    raise AssertionError("a store has at least one table")


def folded(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, from leaves with their siblings."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "other", "left", "right", "subroot", "root"]
        for batch in batches:
            proofs, ends = [], []
            for _, leaf, other, left, right, _, _ in _rows([batch], names):
                proofs.append(digest(*(x for pair in zip(left, right) for x in pair)))
                at = leaf if other is None else other
                for a, b in zip(left, right):
                    at = digest(a, at, b)
                ends.append(at)
            column = {n: batch.column(n) for n in names}
            same = pa.array([a == b for a, b in zip(ends, column["root"].to_pylist())], pa.bool_())
            columns = [column["doc_id"], column["digest"], column["subroot"], column["root"], pa.array(proofs, pa.string()), pa.array(ends, pa.string()), same]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(work: Workspace, leaves: DataFrame) -> DataFrame:
    """Leaves (tree, doc_id, digest, other) with left, right, subroot and root; trees follow each other by name."""
    held = work.put(leaves, "leaves")
    held = work.put(numbered(work, held, ["doc_id", "digest", "other"], "leaves"), "numbered")
    store = build(work, held, "trees")
    ends = work.put(subroots(held, store), "subroots")
    names = ends.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", "level")
    crest = work.put(numbered(work, names, ["source"], "crest"), "crest")
    crest_store = build(work, crest, "crest")
    root = subroots(crest, crest_store)
    none = F.array().cast("array<string>")
    tops = root.select("tree", "level", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    upper = prove(work, crest.withColumn("at", F.col("level").cast("string")).drop("level"), crest_store, tops, ["source", "at"], "crest")
    upper = upper.select(F.col("source").alias("tree"), F.col("at").cast("int").alias("level"), "left", "right", F.col("digest").alias("subroot"), "root")
    upper = work.put(upper, "tops")
    return prove(work, held, store, upper, ["doc_id", "other"], "trees")


def verify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs.

    Leaves are of doc_id, source, lang, n_chars and text; a tree for each source, null first, then by UTF-8 bytes, with
    leaves by doc_id, null first; rows of one doc_id follow by digest. Where crc32 of the id is even, the row is tampered
    with: its text loses its line feeds. A row without a doc_id isn't. `folded_root` is worked out from the row's own
    leaf, tampered or not, and its siblings, and compared with the root. Repeated rows are leaves of their own. A null
    text isn't an empty one. Texts of any length are hashed whole where they lie; an empty table gives an empty result.
    Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "merkle")
    id_, text = F.col("doc_id").cast("long"), F.col("text")
    fields = [id_, F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    touched = F.coalesce((F.crc32(id_.cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n")), F.lit(False))
    other = F.when(touched, leaf_digest(*fields, F.replace(text, F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), id_.alias("doc_id"), leaf_digest(*fields, text).alias("digest"), other.alias("other"))
    return folded(manifest(work, leaves))
