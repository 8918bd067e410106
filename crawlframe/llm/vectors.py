"""Near-duplicate embeddings by a pigeonhole join over subspaces.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. A fixed random rotation spreads that distance over all coordinates; the
rotated vectors are cut into blocks, and two near vectors must be near in some block: within the block's share of the
squared distance, in proportion to its coordinates. Each block is range-joined by cells along its first coordinate, the
union of the candidates is verified by the exact cosine, and a pair counts in the first block that finds it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import map_rows, stored, table
from crawlframe.llm.graph import components

BLOCKS = 4
#: Vectors of a cell that meet in one task at most on either side; larger cells are cut into pieces that meet pairwise.
PIECE = 2_000


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of so many coordinates."""
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def blocks(size: int) -> list[slice]:
    edges = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def budgets(size: int, least: float) -> list[float]:
    """Squared distance that each block may take, with a grain of slack."""
    return [(2 - 2 * least) * (s.stop - s.start) / size * (1 + 1e-9) + 1e-12 for s in blocks(size)]


def units(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(v) -> bool:
    if not v or None in v:
        return False
    x = np.array(v, np.float64)
    n = float(np.sqrt((x * x).sum()))
    return bool(np.isfinite(x).all()) and np.isfinite(n) and n > 0


def dealt(vectors: DataFrame, least: float) -> DataFrame:
    """A row for each vector, block and cell: at home in its own cell, a guest in the next one."""
    def work(rows: dict):
        out: dict[str, list] = {k: [] for k in ("id", "label", "size", "block", "cell", "guest", "v")}
        for i, label, v in zip(rows["id"], rows["label"], rows["v"], strict=True):
            if not usable(v):
                continue
            x = units([v])[0]
            y = rotation_of(len(v)).T @ x
            for j, (s, b) in enumerate(zip(blocks(len(v)), budgets(len(v), least), strict=True)):
                cell = int(np.floor(y[s.start] / (np.sqrt(b) * (1 + 1e-6))))
                for guest in (0, 1):
                    for k, value in (("id", i), ("label", label), ("size", len(v)), ("block", j), ("cell", cell + guest),
                                     ("guest", guest), ("v", np.asarray(v, np.float64).tobytes())):
                        out[k].append(value)
        return out

    turned: dict[int, np.ndarray] = {}

    def rotation_of(size: int) -> np.ndarray:
        if size not in turned:
            turned[size] = rotation(size)
        return turned[size]

    return map_rows(vectors, work, "id long, label string, size int, block int, cell long, guest int, v binary")


def near_pairs(ids, guests, vs, left: np.ndarray, right: np.ndarray, same: bool, block: int, least: float):
    """Index pairs with cosine >= least that this block is the first to find; ``left`` and ``right`` are positions."""
    u = np.frombuffer(b"".join(vs), np.float64).reshape(len(vs), -1)
    u = u / np.sqrt((u * u).sum(1, keepdims=True))
    size = u.shape[1]
    y = u @ rotation(size)
    cuts, limits = blocks(size), np.array(budgets(size, least))
    part = y[:, cuts[block]]
    norms = (part * part).sum(1)
    found_a, found_b = [], []
    for at in range(0, len(left), 256):
        a = left[at:at + 256]
        near = norms[a][:, None] + norms[right][None] - 2 * part[a] @ part[right].T <= limits[block] + 1e-9
        near &= (guests[a][:, None] + guests[right][None]) < 2
        near &= ids[a][:, None] != ids[right][None]
        if same:
            near &= np.arange(at, at + len(a))[:, None] < np.arange(len(right))[None]
        if near.any():
            near &= u[a] @ u[right].T >= least - 1e-9
            i, j = np.nonzero(near)
            found_a.append(a[i])
            found_b.append(right[j])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 20_000):
        x, z = a[at:at + 20_000], b[at:at + 20_000]
        d = (y[x] - y[z]) ** 2
        first = np.argmax(np.stack([d[:, s].sum(1) for s in cuts], axis=1) <= limits, axis=1)
        keep[at:at + 20_000] = (first == block) & ((u[x] * u[z]).sum(1) >= least)
    return a[keep], b[keep]


def links(vectors: DataFrame, least: float) -> DataFrame:
    """Linked vectors: ``id``, ``n`` (links found in one task) and ``low`` (smallest id reached by them).

    ``vectors`` has id, label and v. Tasks count all their pairs but return a row per vector only.
    """
    spread = stored(dealt(vectors, least), "subspace-cells")
    where = ["label", "size", "block", "cell"]
    pieces = spread.groupBy(where).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    row = spread.join(pieces, where).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.struct(
        F.least(k, F.col("piece")).alias("p"), F.greatest(k, F.col("piece")).alias("q")))
    met = row.select(*where, "id", "guest", "v", "piece", F.explode(others).alias("e")).select("*", "e.p", "e.q").drop("e")

    def work(key, table_):
        import pyarrow as pa

        ids = table_["id"].to_numpy()
        guests, piece = table_["guest"].to_numpy(), table_["piece"].to_numpy()
        p, q, block = key[4].as_py(), key[5].as_py(), key[2].as_py()
        order = np.argsort(ids, kind="stable")
        left, right = order[piece[order] == p], order[piece[order] == q]
        a, b = near_pairs(ids, guests, table_["v"].to_pylist(), left, right, p == q, block, least)
        low = np.arange(len(ids))
        while True:  # smallest position in id order that links reach
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                break
            low = new
        n = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        hit = n > 0
        return pa.table({"id": ids[hit], "n": n[hit].astype(np.int64), "low": ids[low][hit]})

    return met.groupBy(*where, "p", "q").applyInArrow(work, "id long, n long, low long")


def near_duplicates(df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors are compared only if their labels are equal and not null and they have as many coordinates. Vectors that are
    null, empty, zero or hold null or non-finite components have no link, nor have rows with a null key (their
    component is null, and they are not kept). Rows repeated in all three columns count once; rows that share a key but not the
    vector are compared with others, not with each other. Every row of the input gets a row.
    """
    v = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    found = stored(links(v.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").dropDuplicates(), least), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    per_id = counts.join(groups, F.col("id") == F.col("node"), "left").select("id", "n", "component")
    whole = df.select(F.col(key).alias("_key")).join(per_id, F.col("_key").cast("long") == F.col("id"), "left")
    component = F.coalesce("component", F.col("_key").cast("long"))
    return whole.select(F.col("_key").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"),
                        F.coalesce(component == F.col("_key"), F.lit(False)).alias("kept"))


def op7_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, folder, "embeddings"))


ORACLE_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""
