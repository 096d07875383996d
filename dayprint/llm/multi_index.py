"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors has its own codebook; a vector lies in the cell (i, j) of the product grid given by its nearest
centroids. A query visits cells in the order of rising distance d1[i] + d2[j] (the multi-sequence order) up to a number
of cells learnt beforehand. Vectors met in visited cells are compared by their cosine in double precision; each pair is
looked for from both sides.

The number of cells rests on two kinds of evidence. Real: a sample of queries is compared with all rows, itself left
out, and each query that has neighbours counts alike. Made: beside each sampled vector a partner is set in a random
direction at exactly the threshold, the farthest that a link can be. With ENOUGH real queries the visits reach the
target recall on them and FLOOR on made partners; with fewer they reach the target on made partners too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayprint.llm.components import components
from dayprint.llm.store import sized, stored

#: Vectors that the codebooks are fitted on.
FIT_ROWS = 20_000
#: Queries of a first and, where few of them have neighbours, of a second trial, and how many with neighbours are enough.
TRIALS, ENOUGH = (2048, 8192), 100
#: Recall that partners at the threshold must have even where real neighbours are found in fewer cells.
FLOOR = 0.9
#: Numbers that one step of a task holds at once.
STEP = 4_000_000
#: Rows of a cell that one piece of work compares: stored vectors, queries.
STORED, ASKED = 1024, 2048


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k-means centroids of the rows."""
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


class Grid:
    def __init__(self, x: np.ndarray, k: int):
        self.half = x.shape[1] // 2
        self.books = [codebook(h, k) for h in (x[:, : self.half], x[:, self.half :])]

    def distances(self, u: np.ndarray) -> list[np.ndarray]:
        parts = (u[:, : self.half], u[:, self.half :])
        return [(h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1) for h, c in zip(parts, self.books)]

    def cell(self, u: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(u)
        return d1.argmin(1) * len(self.books[1]) + d2.argmin(1)

    def visits(self, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest n cells of each vector, nearest first, and their distances."""
        # about n * log(n) sums are held for each vector
        rows = max(1, int(STEP / (n * (1 + np.log(n)))))
        parts = [self._visits(u[i : i + rows], n) for i in range(0, max(len(u), 1), rows)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _visits(self, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.distances(u)
        o1, o2 = (np.argsort(d, 1, kind="stable")[:, :n] for d in (d1, d2))
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        # the n least sums of two sorted lists lie at ranks with (a + 1) * (b + 1) <= n
        a, b = (r.reshape(-1) for r in np.indices((o1.shape[1], o2.shape[1])))
        keep = (a + 1) * (b + 1) <= n
        a, b = a[keep], b[keep]
        sums = s1[:, a] + s2[:, b]
        first = np.argsort(sums, 1, kind="stable")[:, :n]
        cells = np.take_along_axis(o1[:, a] * d2.shape[1] + o2[:, b], first, 1)
        return cells, np.take_along_axis(sums, first, 1)

    def rank(self, u: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each vector visits up to the given cell and those as near as it, in whatever order ties come."""
        d1, d2 = self.distances(u)
        k = d2.shape[1]
        rows = np.arange(len(u))
        far = d1[rows, cell // k] + d2[rows, cell % k]
        d2 = np.sort(d2, 1)
        return np.array([np.searchsorted(d2[r], far[r] - d1[r] + 1e-9, "right").sum() for r in rows])


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _placed(shared):
    grid = shared

    def run(frames):
        for f in frames:
            if len(f):
                u = unit(f["embedding"])
                yield f.assign(cell=grid.value.cell(u))

    return run


def _trial_ranks(grid, queries, threshold):
    """(query, rank, n): how many neighbours of each trial query lie in the cell that it visits at this rank."""

    def run(frames):
        keys, q = queries.value
        for f in frames:
            step = max(1, STEP // len(q))
            for part in (f.iloc[i : i + step] for i in range(0, len(f), step)):
                u, key = unit(part["embedding"]), part["key"].to_numpy()
                mine, other = np.nonzero(q @ u.T >= threshold)
                real = keys[mine] != key[other]
                mine, other = mine[real], other[real]
                if not len(mine):
                    continue
                pairs, n = np.unique(np.stack([mine, grid.value.cell(u)[other]]), axis=1, return_counts=True)
                yield pd.DataFrame({"query": pairs[0], "rank": grid.value.rank(q[pairs[0]], pairs[1]), "n": n})

    return run


def partner_ranks(grid: Grid, q: np.ndarray, threshold: float, seed: int = 7) -> np.ndarray:
    """Cells to visit until each vector and a partner at the threshold, in a random direction, meet from either side."""
    away = np.random.default_rng(seed).standard_normal(q.shape)
    away -= (away * q).sum(1)[:, None] * q
    far = np.linalg.norm(away, axis=1)[:, None]
    partner = threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * away / np.where(far > 0, far, 1)
    return np.minimum(grid.rank(q, grid.cell(partner)), grid.rank(partner, grid.cell(q)))


def depth(real: list[tuple[int, float]], queries: int, made: np.ndarray, recall: float) -> int:
    """The number of visited cells: `real` are (rank, recall gained there) added up over `queries`, `made` ranks of partners."""
    ranks = np.sort(made)
    at = lambda share: int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)])
    needed = at(FLOOR if queries >= ENOUGH else recall)
    if queries:
        order = sorted(real)
        met = np.cumsum([w for _, w in order]) / queries
        needed = max(needed, order[int(min(np.searchsorted(met, recall - 1e-9), len(met) - 1))][0])
    return needed


def _learnt_depth(reps: DataFrame, grid, total: int, threshold: float, recall: float) -> int:
    spark = reps.sparkSession
    for seed, wanted in enumerate(TRIALS):
        drawn = reps.sample(min(1.0, wanted / total), 11 + seed).limit(2 * wanted).select("key", "embedding").collect() or [reps.select("key", "embedding").first()]
        q = unit([r["embedding"] for r in drawn])
        shared = spark.sparkContext.broadcast((np.array([r["key"] for r in drawn], np.int64), q))
        found = reps.select("key", "embedding").mapInPandas(_trial_ranks(grid, shared, threshold), "query long, rank long, n long")
        found = stored(found.groupBy("query", "rank").agg(F.sum("n").alias("n")), "trial")
        each = found.groupBy("query").agg(F.sum("n").alias("all"))
        queries = each.count()
        if queries >= ENOUGH or wanted >= total:
            break
    # one row for each rank met, as many as there are cells at most
    real = found.join(F.broadcast(each), "query").groupBy("rank").agg(F.sum(F.col("n") / F.col("all")).alias("gain")).collect()
    return depth([(r["rank"], r["gain"]) for r in real], queries, partner_ranks(grid.value, q, threshold), recall)


def _asked(grid, n, occupied):
    def run(frames):
        for f in frames:
            step = max(1, STEP // (64 * n))
            for part in (f.iloc[i : i + step] for i in range(0, len(f), step)):
                cells, _ = grid.value.visits(unit(part["embedding"]), n)
                row, nth = np.nonzero(occupied.value[cells])
                flat = part.iloc[row][["rep", "copies", "embedding"]]
                yield flat.assign(home=part["cell"].to_numpy()[row], cell=cells[row, nth])

    return run


def _least(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least name in the component of each row and column of a matrix of links."""
    none = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(links, a[:, None], none).min(0))
        new_a = np.minimum(a, np.where(links, new_b[None, :], none).min(1))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compared(grid, n, threshold):
    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = {c: g for c, g in index.groupby(["cell", "part", "share"], sort=False)}
        for c, queries in asked.groupby(["cell", "part", "share"], sort=False):
            rows = sides.get(c)
            if rows is None:
                continue
            u, v = unit(queries["embedding"]), unit(rows["embedding"])
            links = u @ v.T >= threshold
            a, b = queries["rep"].to_numpy(), rows["rep"].to_numpy()
            links &= a[:, None] != b[None, :]
            if not links.any():
                continue
            # a stored vector that would not visit the query's cell gets the link from here
            one, two = np.nonzero(links)
            linked = np.unique(two)
            cells, _ = grid.value.visits(v[linked], n)
            total = len(grid.value.books[0]) * len(grid.value.books[1])
            visited = (linked[:, None] * total + cells).reshape(-1)
            home = queries["home"].to_numpy()
            unseen = np.zeros(links.shape, bool)
            unseen[one, two] = ~np.isin(two * total + home[one], visited)
            of_a, of_b = _least(links, a, b)
            some, some_b = links.any(1), links.any(0)
            out.append(pd.DataFrame({"rep": a[some], "other": of_a[some], "n_links": (links @ rows["copies"].to_numpy())[some]}))
            out.append(pd.DataFrame({"rep": b[some_b], "other": of_b[some_b], "n_links": (queries["copies"].to_numpy() @ unseen)[some_b]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "other": [], "n_links": []}, dtype="int64")

    return run


def _unit_rows(vectors: DataFrame) -> DataFrame:
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.select("vec_id", "embedding", (F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).alias("sound"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id of every row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components, and those of another length than most
    vectors, link with nothing. Equal vectors are compared once and counted as often as they occur, also under one
    vec_id; further columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = _unit_rows(vectors)
    lengths = rows.where("sound").groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    width = lengths[0]["d"] if lengths else 0
    usable = F.col("sound") & (F.size("embedding") == width)
    key = F.xxhash64("embedding")
    rows = rows.select("vec_id", "embedding", F.when(usable, key).alias("key"), F.when(usable, F.hash("embedding")).alias("key2"))
    reps = rows.where("key is not null").groupBy("key", "key2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    reps = stored(reps, "vectors")
    total = reps.count()
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not total:
        return alone
    fit = unit([r[0] for r in reps.sample(min(1.0, FIT_ROWS / total), 5).limit(2 * FIT_ROWS).select("embedding").collect()] or [reps.first()["embedding"]])
    k = int(min(1024, max(4, 2 ** round(np.log2(np.sqrt(total / 16))))))
    grid = spark.sparkContext.broadcast(Grid(fit, k))
    cells = min(k * k, _learnt_depth(reps, grid, total, threshold, recall))

    kind = reps.schema["embedding"].dataType.simpleString()  # as precise as the input
    index = stored(reps.select("rep", "copies", "embedding").mapInPandas(_placed(grid), f"rep long, copies long, embedding {kind}, cell long"), "index")
    # empty cells are not visited; there are k * k cells at most, about a million
    filled = np.zeros(len(grid.value.books[0]) * len(grid.value.books[1]), bool)
    filled[[r["cell"] for r in index.select("cell").distinct().collect()]] = True
    occupied = spark.sparkContext.broadcast(filled)
    asked = stored(index.mapInPandas(_asked(grid, cells, occupied), f"rep long, copies long, embedding {kind}, home long, cell long"), "asked")
    # crowded cells: stored vectors and queries are dealt out, and each part of one meets each part of the other
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / STORED).cast("int").alias("parts"))
    shares = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("shares"))
    sizes = sized(stored(sizes.join(shares, "cell"), "cells"), 16)
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, "cell").withColumn("part", deal("parts")).withColumn("share", every("shares"))
    right = asked.join(sizes, "cell").withColumn("share", deal("shares")).withColumn("part", every("parts"))
    bundle = F.when((F.col("parts") == 1) & (F.col("shares") == 1), F.pmod(F.xxhash64("cell"), F.lit(max(16, total // 512)))).otherwise(F.xxhash64("cell", "part", "share"))
    left, right = (x.withColumn("piece", bundle).drop("parts", "shares") for x in (left, right))
    found = left.groupBy("piece").cogroup(right.groupBy("piece")).applyInPandas(_compared(grid, cells, threshold), "rep long, other long, n_links long")
    found = stored(found, "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    named = reps.select("key", "key2", "rep", "copies").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("key", "key2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.where("key is not null").select("vec_id", "key", "key2").join(named, ["key", "key2"]).select("vec_id", "n_links", "component_id").union(alone)


def link_recall(vectors: DataFrame, links: DataFrame, threshold: float = 0.95, every: int = 20) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose vec_id is divisible by `every`, by exact comparison with all rows.

    `links` is the result of `near_vectors`. Queries are compared in blocks, a brute-force measurement for judging an
    index; `every` sets its cost. Each vec_id must occur once.
    """
    spark = vectors.sparkSession
    rows = _unit_rows(vectors).where("sound").select("vec_id", "embedding")
    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).join(links.select("vec_id", "n_links"), "vec_id").orderBy("vec_id")
    found = there = 0
    block: list = []

    def compared(block) -> int:
        ids = np.array([r["vec_id"] for r in block], np.int64)
        shared = spark.sparkContext.broadcast((ids, unit([r["embedding"] for r in block])))

        def run(frames):
            ids, q = shared.value
            for f in frames:
                step = max(1, STEP // len(q))
                for part in (f.iloc[i : i + step] for i in range(0, len(f), step)):
                    part = part[part["embedding"].map(len) == q.shape[1]]
                    if len(part):
                        close = q @ unit(part["embedding"]).T >= threshold
                        yield pd.DataFrame({"n": [int((close & (ids[:, None] != part["vec_id"].to_numpy()[None, :])).sum())]})

        return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    for r in asked.toLocalIterator():
        if block and (len(r["embedding"]) != len(block[0]["embedding"]) or len(block) == TRIALS[-1]):
            there, block = there + compared(block), []
        block.append(r)
        found += r["n_links"]
    return found, there + (compared(block) if block else 0)
