"""Near-duplicate vectors: cells by spherical k-means, blocked cosine products within cells.

Only vectors of one label and length are compared. A small label is one cell; for larger ones the number of cells
follows the number of rows, in steps of four. Each vector is at home in the cell of its nearest centre and also visits
every later cell where a neighbour could be at home: if |x - y| <= d and y is nearer to c than to any c', then
x.c' - x.c <= d |c' - c|. So no link is lost to the borders of cells, and a pair of different homes meets once, in the
later one, where the link counts for both. Homes and visitors of a cell are split into blocks of bounded size, and each
pair of blocks is one task's product. Equal vectors are compared once and counted with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.graph import components
from foliant.workspace import Workspace

BLOCK = 2000
#: Numbers of cells; a label has the first with which its cells hold about a block.
LEVELS = (4, 16, 64, 256, 1024)
#: Kinds of cells (length and number) whose centres are fitted; those of further kinds are drawn without data.
KINDS = 1000


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres; empty cells keep their last centre."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def drawn_centres(size: int, k: int) -> np.ndarray:
    """Unit centres of that length, the same in every task."""
    return _unit(np.random.default_rng((size, k)).normal(size=(k, size)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def block_links(left: np.ndarray, right: np.ndarray, ids_left: np.ndarray, ids_right: np.ndarray, copies_left: np.ndarray, copies_right: np.ndarray, guest: np.ndarray, least: float):
    """For left and right vectors the number of others linked with them, and edges that connect what the block links.

    Left vectors that are at home here too find each pair twice, once from either side; guests find it once.
    """
    near = left @ right.T >= least
    near &= ids_left[:, None] != ids_right[None, :]
    links = near @ copies_right
    back = near[guest].T @ copies_left[guest]
    rows, columns = near.any(axis=1), near.any(axis=0)
    near, a, b = near[rows][:, columns], ids_left[rows], ids_right[columns]
    edges_a = edges_b = np.zeros(0, np.int64)
    if len(a):
        low_a, low_b, top = a.copy(), b.copy(), np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(low_a, np.where(near, low_b[None, :], top).min(axis=1))
            new_b = np.minimum(low_b, np.where(near, new_a[:, None], top).min(axis=0))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        edges_a, edges_b = np.concatenate([a, b]), np.concatenate([low_a, low_b])
    return links, back, edges_a, edges_b


def link(vectors: DataFrame, *, least: float = 0.98, sample: int = 20_000, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    Only rows of one label, not null, and of one length are compared. Vectors that are null, zero, or hold null or
    non-finite components have no links and stand alone. The centres are fitted on about `sample` vectors (at most
    twice as many come to the driver); every row is compared whatever they are. Repeated rows and equal vectors are
    linked with each other. Where one vec_id has several vectors of a label, the one whose hash is least is compared with
    other vectors; all get the links and the component of their id. An empty table gives an empty result; columns
    besides vec_id, embedding and label are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embed")
    sound = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False),
    )
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))  # one zero
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), plain.alias("v"), sound.alias("sound"))
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(17), "v"), "length": F.size("v")})
    keys = ["label", "length", "h1", "h2"]
    reps = work.put(keyed.where("sound").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    own = keyed.where("sound").join(reps.select(*keys, F.col("rep").alias("vec_id"), "copies"), [*keys, "vec_id"])
    one = F.min(F.struct("h1", "h2", "label", "length", "copies", "v")).alias("o")
    own = work.put(own.groupBy("vec_id").agg(one).select("o.label", "o.length", "vec_id", "o.copies", "o.v"), "own")
    sizes = work.put(own.groupBy("label", "length").agg(F.count("*").alias("n")), "labels")
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    level = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        level = F.when(F.col("n") <= k * block, k).otherwise(level)
    sizes = sizes.select("label", "length", F.when(F.col("n") <= 2 * block, 0).otherwise(level).alias("level"))
    centres: dict[tuple[int, int], np.ndarray] = {}
    wanted = [(r["length"], r["level"]) for r in sizes.where("level > 0").select("length", "level").distinct().limit(KINDS).collect()]  # a level's cells, whatever the labels
    if wanted:
        picked = own.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / total) * (1 << 20)))).select("length", "v").limit(2 * sample).collect()
        for size, k in wanted:
            held = [r["v"] for r in picked if r["length"] == size]
            centres[size, k] = spherical_kmeans(_unit(np.array(held, float)), min(k, max(1, len(held) // 10))) if held else np.eye(1, size)
    shared = spark.sparkContext.broadcast(centres)
    reach = math.sqrt(2 - 2 * least) + 1e-9

    def assign(batches):
        names = ["label", "length", "vec_id", "copies", "v", "cell", "home"]
        for batch in batches:
            kinds = np.stack([batch.column(1).to_numpy(), batch.column(5).to_numpy()], 1)
            for size, k in np.unique(kinds, axis=0).tolist():
                part = batch.filter(pa.array((kinds == (size, k)).all(axis=1))).select(names[:5])
                if k == 0:  # a small label
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, bool))], names)
                    continue
                c = shared.value[size, k] if (size, k) in shared.value else drawn_centres(size, k)
                dots = _unit(_matrix(part.column(4))) @ c.T
                home = dots.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
                visit = np.arange(len(c))[None, :] > home[:, None]
                for other in range(len(c)):
                    visit &= dots[:, [other]] - dots <= reach * apart[other][None, :] + 1e-9
                visit[np.arange(len(home)), home] = True
                row, cell = np.nonzero(visit)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home[row] == cell)], names)

    levelled = own.join(sizes, ["label", "length"]).select("label", "length", "vec_id", "copies", "v", "level")
    placed = work.put(levelled.mapInArrow(assign, "label string, length int, vec_id long, copies long, v array<double>, cell int, home boolean"), "placed")
    group = ["label", "length", "cell"]
    sizes = work.put(placed.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("n_home")).where("n_home > 0 and n > 1"), "sizes")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    blocked = placed.join(sizes, group).select(*group, "vec_id", "copies", "v", "home", parts("n_home").alias("homes"), parts("n").alias("visits"))
    at = lambda c, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    visitors = blocked.select(*group, "vec_id", "copies", "v", F.lit(False).alias("host"), (~F.col("home")).alias("guest"), at("visits", 1).alias("i"), every("homes").alias("j"))
    homes = blocked.where("home").select(*group, "vec_id", "copies", "v", F.lit(True).alias("host"), F.lit(False).alias("guest"), at("homes", 2).alias("j"), every("visits").alias("i"))

    def compare(table: pa.Table) -> pa.Table:
        host = table.column("host").to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(~host)), table.filter(pa.array(host))
        if not a.num_rows or not b.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        (ids_a, copies_a), (ids_b, copies_b) = ((t.column("vec_id").to_numpy(), t.column("copies").to_numpy()) for t in (a, b))
        guest = a.column("guest").to_numpy(zero_copy_only=False)
        links, back, edges_a, edges_b = block_links(_unit(_matrix(a.column("v"))), _unit(_matrix(b.column("v"))), ids_a, ids_b, copies_a, copies_b, guest, least)
        ids, counts = np.concatenate([ids_a[links > 0], ids_b[back > 0]]), np.concatenate([links[links > 0], back[back > 0]])
        none, n = np.zeros(len(edges_a), np.int64), len(ids)
        return pa.table({
            "vec_id": np.concatenate([ids, edges_a]), "links": np.concatenate([counts, none]).astype(np.int64),
            "root": pa.array(np.concatenate([np.zeros(n, np.int64), edges_b]), mask=np.concatenate([np.ones(n, bool), np.zeros(len(none), bool)])),
        })

    linked = work.put(visitors.unionByName(homes).groupBy(*group, "i", "j").applyInArrow(compare, "vec_id long, links long, root long"), "linked")
    roots = components(work, linked.where("root is not null").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("vec_id").agg(F.sum("links").alias("links"))
    per_rep = reps.withColumnRenamed("rep", "vec_id").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per_rep = work.put(per_rep.select(*keys, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")), "classes")
    work.only(per_rep)
    whole = keyed.select("vec_id", "sound", *(F.when(F.col("sound"), F.col(k)).alias(k) for k in keys)).join(per_rep, keys, "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
