"""Near-duplicate vectors by an exact metric range join over pivot cells.

Vectors are scaled to unit length, where cosine >= c is chord distance <=
sqrt(2 - 2 c).  Equal vectors form a class first, counted once.  Pivots, spread by
farthest-first choice over a sample of the classes, partition the classes: each goes to
the cell of its nearest pivot, its home.  There is one pivot for every ``BLOCK`` classes, up to
``MAX_PIVOTS``, so cells keep their size as the table grows.  A class y at home in cell j is replicated to a
lower cell i only if the triangle inequality cannot exclude a partner there: its distance
to pivot i is at most both radius(i) + eps and its distance to its own pivot + 2 eps.  So each pair meets in
exactly one cell, the lower of the two homes, and cells join independently.

A cell of many members is dealt over blocks; a task compares two blocks by matrix
product in double precision.  Vectors travel as they are stored and are scaled in the task.  No pair leaves a task: it returns the number of links per
class and one edge from each linked class to the least of its group in the task, which
keeps every connection.

Defined results.  Null, zero-length, zero or non-finite vectors and those with null
components: no links, their own component, kept.  Vectors of different lengths are
never linked.  Repeated rows are linked with each other; rows of one id with different
vectors are different vectors; a null id links nothing, has a null
component and is kept.  An empty table gives no rows.  Without clusters in
many dimensions the inequality excludes little and cells see most of the lower cells' range: the
cost then tends to all pairs, as for any exact method.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, need, shuffle_partitions

#: Classes of a cell, and of a side of a task, about.
BLOCK = 8192
#: Rows that the pivots are chosen from, and the least and greatest number of pivots.
SAMPLE, MIN_PIVOTS, MAX_PIVOTS = 16_384, 8, 4096
#: Products of a matrix product that are held at a time.
PRODUCTS = 1 << 22
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Not null, with components that are all finite and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe against overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first choice: every pivot is the row farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def to_rows(column: pd.Series, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of binary ones whose components are of ``kind``."""
    return unit(np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64))


def close(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y have at least this cosine."""
    out = np.empty((len(x), len(y)), bool)
    step = max(1, PRODUCTS // max(1, len(y)))
    for at in range(0, len(x), step):
        np.greater_equal(x[at:at + step] @ y.T, cosine, out=out[at:at + step])
    return out


def cells(classes: DataFrame, pivots: dict[int, np.ndarray], eps: float, kind: str) -> DataFrame:
    """``(dim, cell, home, id, copies, v)``: every class at home, and where it must be replicated.

    ``pivots``: by vector length; at most ``MAX_PIVOTS`` each.
    """
    size = np.dtype(kind).itemsize
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def homes(it):
        for pdf in it:
            for dim, part in pdf.groupby(pdf["v"].map(len) // size):
                x = to_rows(part["v"], kind)
                p = shared.value[dim]
                d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
                home = d.argmin(1)
                yield pd.DataFrame({"dim": dim, "home": home, "radius": d[np.arange(len(x)), home],
                                    "id": part["id"].to_numpy(), "copies": part["copies"].to_numpy(), "v": part["v"].to_numpy()})

    at_home = cut(classes.select("id", "copies", "v").mapInPandas(
        homes, "dim int, home int, radius double, id long, copies long, v binary"))
    # a radius per pivot
    radii = {(r["dim"], r["home"]): r["radius"] for r in at_home.groupBy("dim", "home").agg(F.max("radius").alias("radius")).collect()}
    limits = at_home.sparkSession.sparkContext.broadcast(radii)

    def replicas(it):
        for pdf in it:
            yield pdf.assign(cell=pdf["home"], is_home=True)[["dim", "cell", "is_home", "id", "copies", "v"]]
            for dim, part in pdf.groupby("dim"):
                x, p = to_rows(part["v"], kind), shared.value[dim]
                d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
                reach = np.array([limits.value.get((dim, i), -2.0) for i in range(len(p))]) + eps + SLACK
                there = (d <= reach) & (d <= part["radius"].to_numpy()[:, None] + 2 * eps + SLACK)
                there &= np.arange(len(p)) < part["home"].to_numpy()[:, None]
                row, cell = np.nonzero(there)
                if len(row):
                    yield pd.DataFrame({"dim": dim, "cell": cell, "is_home": False, "id": part["id"].to_numpy()[row],
                                        "copies": part["copies"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

    return at_home.mapInPandas(replicas, "dim int, cell int, is_home boolean, id long, copies long, v binary")


def products(near: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """near @ copies, for the few rows that have a partner."""
    out = np.zeros(len(near), np.int64)
    for i in np.flatnonzero(near.any(1)):
        out[i] = copies[near[i]].sum()
    return out


def local_groups(near: np.ndarray) -> np.ndarray:
    """The least row of the component of each row of a symmetric boolean matrix."""
    label = np.arange(len(near))
    rows = np.flatnonzero(near.any(1))
    while True:
        new = label.copy()
        for i in rows:
            new[i] = min(label[i], label[near[i]].min())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def local_edges(ids_a: np.ndarray, ids_b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the bipartite links ``near`` (a by b) connect: each row to the least label it sees."""
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    label_a, label_b = np.arange(len(ids_a)), np.full(len(ids_b), len(ids_a))
    while True:
        for j in columns:
            label_b[j] = label_a[near[:, j]].min()
        new = label_a.copy()
        for i in rows:
            new[i] = min(label_a[i], label_b[near[i]].min())
        if (new == label_a).all():
            break
        label_a = new
    return np.concatenate([ids_a[rows], ids_b[columns]]), np.concatenate([ids_a[label_a[rows]], ids_a[label_b[columns]]])


def linked(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, size = ("<f4", 4) if single else ("<f8", 8)
    rows = need(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    rows = rows.withColumn("fine", usable(F.col("e")) & F.col("vec_id").isNotNull())
    # equal vectors meet by a 128-bit hash of their components
    text = F.array_join(F.transform("e", lambda x: (x + F.lit(0.0)).cast("string")), ",")
    keyed = rows.select("vec_id", "e", F.when(F.col("fine"), F.md5(text.cast("binary"))).alias("key"))
    grouped = keyed.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e"))

    def packed(it):
        for pdf in it:
            yield pd.DataFrame({"key": pdf["key"], "least_id": pdf["least_id"], "copies": pdf["copies"],
                                "v": [np.asarray(x, kind).tobytes() for x in pdf["e"]]})

    # numbered as they are written, so a number stays with its class
    classes = cut(grouped.mapInPandas(packed, "key string, least_id long, copies long, v binary").withColumn("id", F.monotonically_increasing_id()))
    sample = classes.select("id", "v").orderBy(F.xxhash64("key"), "id").limit(SAMPLE).toPandas()
    pivots = {}
    # one row per vector length
    for r in classes.groupBy((F.octet_length("v") / size).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).collect():
        own = sample.loc[sample["v"].map(len) == size * r["dim"], "v"]
        if not len(own):  # a rare length that the sample missed
            own = pd.Series([bytes(r["v"])])
        pivots[r["dim"]] = choose_pivots(to_rows(own, kind), min(MAX_PIVOTS, max(MIN_PIVOTS, -(-r["n"] // BLOCK))))
    placed = cut(cells(classes, pivots, eps, kind))

    sizes = placed.groupBy("dim", "cell").agg(
        F.sum(F.col("is_home").cast("long")).alias("n_home"), F.sum((~F.col("is_home")).cast("long")).alias("n_away"))
    sizes = sizes.select(
        F.col("dim").alias("s_dim"), F.col("cell").alias("s_cell"),
        F.ceil(F.col("n_home") / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.col("n_away") / BLOCK).cast("int").alias("away_blocks"))
    # blocks: MAX_PIVOTS rows per vector length at most, so broadcast
    dealt = placed.join(F.broadcast(sizes), (F.col("dim") == F.col("s_dim")) & (F.col("cell") == F.col("s_cell")))
    own = F.when(F.col("is_home"), F.pmod(F.xxhash64("id"), F.col("home_blocks"))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("away_blocks"))).cast("int")
    blocks = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("i"), b.alias("j"))
    mine = F.col("own")
    tasks = F.when(F.col("is_home"), F.concat(
        F.transform(blocks(F.col("home_blocks")), lambda b: task("home", F.least(mine, b), F.greatest(mine, b))),
        F.transform(blocks(F.col("away_blocks")), lambda b: task("away", mine, b)))).otherwise(
        F.transform(blocks(F.col("home_blocks")), lambda a: task("away", a, mine)))
    spread = dealt.withColumn("own", own).select("dim", "cell", "is_home", "id", "copies", "v", "own", F.explode(tasks).alias("t")).select(
        "dim", "cell", "is_home", "id", "copies", "v", "own", "t.kind", "t.i", "t.j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side, i, j = (pdf[c].iloc[0] for c in ("kind", "i", "j"))
        ids, copies, x = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), to_rows(pdf["v"], kind)
        own, at_home = pdf["own"].to_numpy(), pdf["is_home"].to_numpy()
        if side == "home" and i == j:
            order = np.argsort(ids)
            ids, copies, x = ids[order], copies[order], x[order]
            near = close(x, x, cosine)
            np.fill_diagonal(near, False)
            n, label = products(near, copies), local_groups(near)
            return pd.DataFrame({"id": ids, "n": n, "to": ids[label]})[n > 0]
        left = (own == i) & at_home
        right = (own == j) & at_home if side == "home" else ~at_home
        near = close(x[left], x[right], cosine)
        a, b = ids[left], ids[right]
        n_a, n_b = products(near, copies[right]), products(near.T, copies[left])
        src, dst = local_edges(a, b, near)
        count = pd.DataFrame({"id": np.concatenate([a, b]), "n": np.concatenate([n_a, n_b])})
        return count[count["n"] > 0].merge(pd.DataFrame({"id": src, "to": dst}), on="id")

    keys = ["dim", "cell", "kind", "i", "j"]
    n = max(8, shuffle_partitions(spark))
    found = cut(spread.repartition(n, *keys).groupBy(*keys).applyInPandas(compare, "id long, n long, to long"))
    component = connected_components(found.select(F.col("id").alias("src"), F.col("to").alias("dst")).where("src <> dst"))
    # of each component the least id of a vector
    named = component.join(classes.select("id", "least_id"), F.col("id") == F.col("node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("of_class")).withColumnRenamed("component", "l_component")
    member = named.join(least, F.col("component") == F.col("l_component")).select("node", "of_class")
    links = found.groupBy(F.col("id").alias("l_id")).agg(F.sum("n").alias("others"))
    c = classes.select("key", "id", "copies", "least_id")
    c = c.join(links, F.col("id") == F.col("l_id"), "left").join(member, F.col("id") == F.col("node"), "left").select(
        F.col("key").alias("c_key"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("others"),
        F.coalesce("of_class", "least_id").alias("of_class"))
    return keyed.select("vec_id", "key").join(c, F.col("key") == F.col("c_key"), "left").select(
        "vec_id", F.coalesce("others", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("of_class", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


#: Compares all pairs, so this is meant for small tables.
ORACLE_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.dst FROM reach JOIN links ON links.src = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON a = vec_id LEFT JOIN n ON src = vec_id
"""
