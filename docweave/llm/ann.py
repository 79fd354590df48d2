"""Approximate nearest neighbours by balanced posting lists.

1. Equal vectors are one class.  Classes are searched, ids come back at the end,
   so a vector that a third of all rows share costs one row.
2. Centroids come from balanced bisection of a bounded sample (``SAMPLE`` classes or
   ``SAMPLE_BYTES``, by hash): each cut halves its rows, so lists are even.  There
   are about as many as the root of the classes, 2 to ``LISTS``.
3. Centroids are linked in a graph (near ones, and a few far ones as shortcuts) that
   every task holds; a beam walks it to find a vector's nearest centroids.
4. A vector goes to its nearest list and, near a boundary, to up to
   ``REPLICAS`` - 1 further lists whose centroid is within ``BOUNDARY`` times that
   distance.  Every row is indexed.
5. A query reads the lists whose centroid is within ``ratio`` times its nearest
   centroid's distance, and further ones until they hold k others.  The ratio is the
   smallest that reaches ``TARGET`` recall for queries of the sample against it.
6. A list of more than ``split`` vectors is cut again in the same way, by centroids
   of its own (``PARTS`` of them, from a sample of the list), in rounds until lists
   are small.  Its vectors and queries meet them in tasks of bounded size, so lists
   grow in number with the rows, and not in length.
7. Lists are cut into blocks of bounded size; each block meets its list's queries,
   in parts by their own number, and emits each query's best of it.  A
   ranked window, pruned before its shuffle, leaves the best overall.

Inner products are turned into distances by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, 0 for queries.  Scores are double
precision on the original vectors.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows with null ids, take no part.  Vectors of each length have an index of their
own, as no product joins them to others.  Equal rows are one candidate; an id with
several vectors is that many candidates and asks that often.  Ties go to the
smaller id.  An empty table gives an empty result; further columns are ignored.

What a task is sent is at most ``LISTS`` centroids with their links, or, for a list
that is cut, ``PARTS`` of them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.blocks import keyed_join
from docweave.scratch import saved

SAMPLE, SAMPLE_BYTES, LISTS, LIST_BLOCK, QUERY_BLOCK = 20_000, 64 << 20, 4096, 8192, 16_384
SPLIT, PARTS, SPLIT_SAMPLE, ROUNDS = 16_384, 32, 4096, 8
DEGREE, BEAM, REPLICAS, BOUNDARY, TARGET = 16, 12, 2, 1.02, 0.97
RATIOS = np.concatenate([np.arange(1.0, 1.5, 0.01), np.arange(1.5, 4.0, 0.1)])
ALL = 1e9


def bisected(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` (a power of two) equal parts of x."""
    if lists == 1 or len(x) < 2:
        return np.repeat(x.mean(0, keepdims=True), lists, 0)
    ends = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(4):
        side = x @ (ends[1] - ends[0])
        order = np.argsort(side, kind="stable")
        halves = x[order[: len(x) // 2]], x[order[len(x) // 2 :]]
        ends = np.stack([h.mean(0) for h in halves])
    return np.concatenate([bisected(h, lists // 2, rng) for h in halves])


class Graph:
    """Centroids and their links; ``walk`` is a beam search for many vectors at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 3):
        n = len(centroids)
        self.centroids, self.size = centroids, (centroids**2).sum(1)
        near = np.empty((n, min(DEGREE, n)), np.int64)
        for at in range(0, n, 1024):
            d = self.size[None, :] - 2 * centroids[at : at + 1024] @ centroids.T
            near[at : at + 1024] = np.argsort(d, 1, kind="stable")[:, : near.shape[1]]
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        back = [set(row) for row in np.concatenate([near, far], 1).tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < 2 * DEGREE:
                    back[j].add(i)
        width = max(map(len, back))
        self.links = np.array([sorted(s) + [min(s)] * (width - len(s)) for s in back])
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def distances(self, x: np.ndarray, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x[rows] ** 2).sum(1)[:, None] - 2 * np.einsum("ij,ikj->ik", x[rows], self.centroids[lists]) + self.size[lists], 0))

    def all_distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + self.size, 0))

    def walk(self, x: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
        """Distances to the centroids that were met (inf for the others).

        Stops for a vector when its nearest unexpanded centroid is neither among
        its ``beam`` nearest nor within ratio of the nearest.
        """
        n, m = len(self.centroids), len(x)
        seen = np.full((m, n), np.inf)
        seen[:, self.entry] = self.distances(x, np.arange(m), np.repeat(self.entry[None], m, 0))
        waiting = seen.copy()
        active = np.arange(m)
        beam = min(beam, n)
        while len(active):
            pick = waiting[active].argmin(1)
            d = waiting[active, pick]
            rest = np.partition(seen[active], beam - 1, axis=1)[:, beam - 1]
            go = np.isfinite(d) & (d <= np.maximum(rest, ratio * seen[active].min(1)))
            active, pick = active[go], pick[go]
            if not len(active):
                break
            waiting[active, pick] = np.inf
            links = self.links[pick]
            new = ~np.isfinite(seen[active[:, None], links])
            if new.any():
                rows = np.flatnonzero(new.any(1))
                found = self.distances(x, active[rows], links[rows])
                r, c = np.nonzero(new[rows])
                seen[active[rows[r]], links[rows][r, c]] = found[r, c]
                waiting[active[rows[r]], links[rows][r, c]] = found[r, c]
        return seen


def nearest_lists(seen: np.ndarray, ratio: float, most: int | None = None) -> list[np.ndarray]:
    """For each row, the lists within ratio of the nearest, nearest first."""
    limit = seen.min(1) * ratio
    return [(own := np.flatnonzero(d <= top))[np.argsort(d[own], kind="stable")][:most] for d, top in zip(seen, limit, strict=True)]


class Index:
    """Graph, largest norm and ratio: what a task needs to know."""

    def __init__(self, sample: np.ndarray, lists: int, norm: float, k: int, seed: int = 5):
        self.norm = norm
        raised = self.raised(sample)
        self.graph = Graph(bisected(raised, lists, np.random.default_rng(seed)))
        self.ratio = self.calibrated(sample, raised, k)

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1, keepdims=True), 0))], 1)

    @staticmethod
    def lowered(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], 1)

    def calibrated(self, sample: np.ndarray, raised: np.ndarray, k: int) -> float:
        queries = sample[:: max(1, len(sample) // 200)][:200]
        best = np.argsort(-(queries @ sample.T), 1, kind="stable")[:, 1 : k + 1]
        wanted = np.unique(best)
        if not len(wanted):
            return ALL
        homes = dict(zip(wanted.tolist(), self.homes(raised[wanted]), strict=True))
        # exact distances here: what the walk misses is small and the target leaves room
        d = self.graph.all_distances(self.lowered(queries))
        d /= np.maximum(d.min(1, keepdims=True), 1e-300)
        need = np.array([[d[q, homes[b]].min() for b in row] for q, row in enumerate(best.tolist())])
        return next((float(r) for r in RATIOS if (need <= r).mean() >= TARGET), ALL)

    def homes(self, raised: np.ndarray) -> list[np.ndarray]:
        return nearest_lists(self.graph.walk(raised, BOUNDARY), BOUNDARY, REPLICAS)

    def posted(self, x: np.ndarray) -> list[np.ndarray]:
        return self.homes(self.raised(x))

    def probes(self, queries: np.ndarray, held: np.ndarray, need: int) -> list[np.ndarray]:
        """Lists to read; held counts the vectors of each list, replicas left out."""
        low = self.lowered(queries)
        out = nearest_lists(self.graph.walk(low, self.ratio), self.ratio)
        short = [i for i, own in enumerate(out) if held[own].sum() < need]
        for at in range(0, len(short), 256):
            rows = short[at : at + 256]
            for i, order in zip(rows, np.argsort(self.graph.all_distances(low[rows]), 1, kind="stable"), strict=True):
                most = int(np.searchsorted(np.cumsum(held[order]), min(need, held.sum()))) + 1
                out[i] = np.union1d(out[i], order[:most])
        return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def dealt_out(part: pa.RecordBatch | pa.Table, lists: list[np.ndarray], number) -> pa.Table:
    """A row for each list of each row of part; ``is_home`` marks a row's first list."""
    times = np.array([len(x) for x in lists])
    out = pa.table(part.columns, names=part.schema.names).take(pa.array(np.repeat(np.arange(part.num_rows), times)))
    chosen = number(np.concatenate([np.zeros(0, np.int64), *lists]))
    first = np.zeros(len(chosen), bool)
    first[np.cumsum(times) - times] = True
    return pa.table({"list": pa.array(chosen, pa.int64()), **{c: out[c] for c in out.column_names if c not in ("list", "is_home")}, "is_home": pa.array(first)})


def _first_lists(lists_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield from dealt_out(part, lists_of(matrix(part.column("v"))), lambda x: x).to_batches()

    return run


def best_of_block(vectors: pa.Table, queries: pa.Table, most: int) -> pa.Table:
    """Each query's best vectors of a block: query, node, least, n, score."""
    names = ["query", "node", "least", "n", "score"]
    empty = pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.float64())], names=names)
    if not len(vectors) or not len(queries):
        return empty
    vectors = vectors.sort_by([("least", "ascending"), ("node", "ascending")])
    nodes, least, n = (vectors[c].to_numpy() for c in ("node", "least", "n"))
    x, own = matrix(vectors["v"]), queries["node"].to_numpy()
    out = [empty]
    for at in range(0, len(queries), 512):
        q = matrix(queries["v"].slice(at, 512))
        products = q @ x.T
        kth = np.partition(products, -most, axis=1)[:, -most] if len(nodes) > most else np.full(len(q), -np.inf)
        # what the last bits of a matrix product may hide is scored again, the same way in every block
        rows, cols = np.nonzero(products >= (kth - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))))[:, None])
        exact = (q[rows] * x[cols]).sum(1)
        best = np.lexsort((nodes[cols], least[cols], -exact, rows))
        rows, cols, exact = rows[best], cols[best], exact[best]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
        rows, cols = rows[keep], cols[keep]
        out.append(pa.table([own[at : at + 512][rows], nodes[cols], least[cols], n[cols], exact[keep]], names=names))
    return pa.concat_tables(out)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, with one kind of zero."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & usable)
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))


def _hashes(df: DataFrame) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.col("v"))})


def _sizes(posted: DataFrame) -> DataFrame:
    return posted.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_home").alias("held"))


def _again(posted: DataFrame, asked: DataFrame, big: DataFrame, level: int, norm: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The lists of ``big`` (list, rows) cut into parts; other lists as they are."""
    number = f"list long, {_fields(posted)}, is_home boolean"
    base = level << 56

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        index = Index(matrix(table["v"]), PARTS, norm, k)
        return pa.table({"list": [key[0].as_py()], "model": pa.array([pickle.dumps(index)], pa.binary())})

    def parts_of(key: tuple) -> int:
        return base + ((key[0].as_py() & (1 << 56) - 1) << 5)

    def post(key: tuple, rows: pa.Table, models: pa.Table) -> pa.Table:
        index = pickle.loads(models["model"][0].as_py())
        return dealt_out(rows.drop_columns(["block"]), index.posted(matrix(rows["v"])), lambda x: parts_of(key) + x)

    def probe(key: tuple, rows: pa.Table, models: pa.Table) -> pa.Table:
        index = pickle.loads(models["model"][0].as_py())
        held = np.zeros(PARTS, np.int64)
        for part in models["parts"][0].as_py() or []:
            held[part["list"] & PARTS - 1] = part["held"]
        return dealt_out(rows.drop_columns(["block"]), index.probes(matrix(rows["v"]), held, k + 1), lambda x: parts_of(key) + x)

    def blocks(rows: DataFrame, sizes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        """Rows of big lists with a block, and each list once for each of its blocks."""
        n = F.greatest(F.ceil(F.col("rows") / size), F.lit(1)).cast("int")
        own = rows.join(sizes.select("list", n.alias("_n")), "list").withColumn("block", F.pmod(F.xxhash64("node"), "_n").cast("int")).drop("_n")
        each = sizes.select("list", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
        return own, each

    kept = [c for c in posted.columns if c != "is_home"]
    chosen = posted.join(big, "list").where(F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / SPLIT_SAMPLE)) == 0).select("list", "v")
    models = saved(chosen.groupBy("list").applyInArrow(fit, "list long, model binary"), "list-models")
    own, each = blocks(posted.select(kept), big, LIST_BLOCK)
    own = own.groupBy("list", "block").cogroup(each.join(models, "list").groupBy("list", "block")).applyInArrow(post, number)
    own = saved(own, "posting-lists")
    home = F.shiftright(F.col("list").bitwiseAND((1 << 56) - 1), 5)
    parts = _sizes(own).groupBy(home.alias("_low")).agg(F.collect_list(F.struct("list", "held")).alias("parts"))  # at most PARTS entries
    models = models.join(parts, models.list.bitwiseAND((1 << 56) - 1) == F.col("_low"), "left").drop("_low")
    asks = saved(asked.join(big.select("list"), "list").groupBy("list").agg(F.count(F.lit(1)).alias("rows")), "long-probes")
    theirs, each = blocks(asked.select(kept), asks, QUERY_BLOCK)
    theirs = theirs.groupBy("list", "block").cogroup(each.join(models, "list").groupBy("list", "block")).applyInArrow(probe, number)
    rest = [x.join(big, "list", "left_anti").select(own.columns) for x in (posted, asked)]
    return rest[0].union(own), saved(rest[1].union(theirs), "probes")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("list", "is_home"))


def _search_classes(classes: DataFrame, k: int, split: int) -> DataFrame:
    """(query, node, least, n, score): the k + 1 best classes of each class that asks, itself among them."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    count, largest, length = classes.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
    share = F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(1 << 30)) < int(min(1, 1.05 * wanted / count) * (1 << 30))
    sample = matrix(classes.where(share).select("v").toArrow()["v"]) if count > wanted else matrix(classes.select("v").toArrow()["v"])
    lists = 1 << max(1, int(math.log2(max(2, min(math.sqrt(count), LISTS, len(sample) // 4)))))
    index = Index(sample, lists, largest, k)

    vectors = classes.select("node", "least", "n", "v")
    schema = f"list long, {_fields(vectors)}, is_home boolean"
    posted = saved(vectors.mapInArrow(_first_lists(index.posted), schema), "posting-lists")
    held = np.zeros(lists, np.int64)
    for r in _sizes(posted).select("list", "held").collect():  # at most LISTS rows
        held[r[0]] = r[1]
    asking = classes.where("asks").select("node", "least", "n", "v")
    asked = saved(asking.mapInArrow(_first_lists(lambda x: index.probes(x, held, k + 1)), schema), "probes")
    for level in range(1, ROUNDS):
        big = saved(_sizes(posted).where(F.col("rows") > split).where(F.shiftright("list", 56) == level - 1).select("list", "rows"), "long-lists")
        if big.isEmpty():
            break
        posted, asked = _again(posted, asked, big, level, largest, k)

    n_blocks = F.ceil(F.col("rows") / LIST_BLOCK).cast("int").alias("blocks")
    n_parts = F.ceil(F.col("rows") / QUERY_BLOCK).cast("int").alias("parts")
    sizes = saved(_sizes(posted).select("list", n_blocks).join(_sizes(asked).select("list", n_parts), "list"), "list-sizes")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    keys = ["list", "block", "part"]
    met = posted.join(sizes, "list").withColumn("block", own("blocks")).withColumn("part", each("parts")).select(*keys, "node", "least", "n", "v")
    theirs = asked.join(sizes, "list").withColumn("part", own("parts")).withColumn("block", each("blocks")).select(*keys, "node", "v")
    found = met.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(lambda a, b: best_of_block(a, b, k + 1), "query long, node long, least long, n long, score double")
    # a replica has its class's score and ids, hence its rank
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "node")
    return found.withColumn("_rank", F.dense_rank().over(best)).where(F.col("_rank") <= k + 1).drop("_rank").distinct()


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", split: int = SPLIT) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of df where is_query holds (on ``id`` and ``v``)."""
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, vector_col)
    asks = F.coalesce(is_query, F.lit(False))
    merged = rows.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.max(asks).alias("asks"))
    classes = saved(_hashes(merged).withColumn("node", F.monotonically_increasing_id()), "classes")
    best = None
    for (length,) in sorted(classes.select(F.size("v")).distinct().collect()):
        own = _search_classes(classes.where(F.size("v") == length), k, split)
        best = own if best is None else best.union(own)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = saved(best, "best-classes")

    # ids of classes of several rows: the k + 1 smallest are all that a ranking can use
    many = classes.where("n > 1").select("h1", "h2", "n", "node")
    ids = keyed_join(_hashes(rows.select("id", "v")).select("id", "h1", "h2"), many, ["h1", "h2"], "n", "inner").select("node", "id").distinct()
    ids = ids.withColumn("_at", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("_at") <= k + 1).select("node", "id")
    single = best.where("n = 1").select("query", "node", F.col("least").alias("id"), "score")
    several = best.where("n > 1").drop("least", "n").join(ids, "node").select("query", "node", "id", "score")
    entry = F.struct((-F.col("score")).alias("less"), "id", "node", "score")
    answers = single.union(several).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("answers"))  # (k + 1)^2 entries at most

    of_class = classes.where("asks").select("h1", "h2", "n", F.col("node").alias("query")).join(answers, "query")
    asked = keyed_join(_hashes(rows.where(asks)).select("id", "h1", "h2").distinct(), of_class, ["h1", "h2"], "n", "inner")
    others = F.filter("answers", lambda a: (a["id"] != F.col("id")) | (a["node"] != F.col("query")))
    ranked = asked.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("_at", "_answer"))
    return ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_answer.id").alias("vec_id"), F.col("_answer.score").alias("score"))
