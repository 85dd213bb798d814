"""Most similar vectors for every vector, by collision-counting hashing.

Each vector has one hash value per random projection. The values of one projection, sorted, are a hash table; a query
opens a window of some width around its own value and collides with the vectors inside. Those that collide in enough
tables are verified; if too few of them are near, the windows are widened (virtual rehashing) and counted again.

The tables are cut into cells first, so that no task sorts or counts over all vectors: cells are those of centroids
fitted on a bounded sample, on two levels once there are many; a vector is indexed in its nearest cell and asks every cell that is nearly as near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.records import latest
from loomgraph.plans.session import cut, small

DIM, K, FLOOR = 64, 10, 0.85
#: Rows the centroids are fitted on, rows meant per cell, centroids of a level, indexed and asking rows of a task's cell.
SAMPLE, PER_CELL, CELLS, PAGE, ASKERS = 16_384, 800, 2048, 4096, 16_384
#: A cell is asked if its centroid's cosine is this close to the nearest's, at a floor of 0.85; lower floors look further.
MARGIN = 0.1
#: Hash tables, a window's half-width per unit of distance, and the collisions that make a candidate. The tables are the
#: axes of a rotation, so a distance's squares over all of them add up to it: at the distance itself some 37 of 64 collide
#: (30 or more for 99 in 100 pairs), at 1.5 times that 26, at twice 20.
TABLES, WIDTH, NEED = DIM, 0.8, 30
#: The windows' distances as shares of the distance that belongs to the floor.
LEVELS = (0.33, 0.58, 1.0)
#: Parts of equal size that each table is cut into; windows are rounded outward to them.
PARTS = 128


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(v: pd.Series) -> np.ndarray:
    """Where a row's vector has finite numbers, not all zero (their length is checked before)."""
    x = np.array([np.asarray(e, np.float32) for e in v]).reshape(-1, DIM)
    return np.isfinite(x).all(1) & (x != 0).any(1)


def current(entities: DataFrame) -> DataFrame:
    """(id, embedding) of the latest state of each id, where its vector has DIM finite numbers, not all zero.

    Few ids come twice: only their rows are moved to find the latest.
    """
    twice = small(entities.groupBy("id").count().where("count > 1").select("id"))
    rows = entities.select("id", "embedding", "ingested_at").where("id IS NOT NULL")
    once = rows.join(twice, "id", "left_anti").select("id", "embedding")
    more = latest(rows.join(twice, "id", "left_semi"), ["id"], "ingested_at", ["embedding"])
    # Null with a null entry, NaN or infinite with such a one; squares of floats neither overflow a double nor vanish.
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("float").cast("double") * x.cast("float").cast("double"))
    return once.unionByName(more).where((F.size("embedding") == DIM) & (square > 0) & (square < float("inf")))


def radius(floor: float) -> float:
    """The distance of unit vectors whose cosine is ``floor``."""
    return float(np.sqrt(2 - 2 * floor))


def margin(floor: float) -> float:
    """How much less near than the nearest a cell may be that is still asked for cosines of ``floor``."""
    spread = lambda f: np.sqrt(1 - f * f) / f
    return float(MARGIN * spread(floor) / spread(0.85))


def _means(x: np.ndarray, k: int, length: bool) -> tuple[np.ndarray, np.ndarray]:
    """``k`` means of the rows of ``x`` and the nearest of each row; of length one if ``length``."""
    c = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for last in range(7):
        half = (c * c).sum(1) / 2
        near = np.concatenate([(x[i : i + 2048] @ c.T - half).argmax(1) for i in range(0, len(x), 2048)])
        if last == 6:
            break
        total, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1) if length else n.astype(np.float32)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c, near


class Cells:
    """Centroids on two levels: a cell is a coarse centroid plus a fine one, a mean of what the coarse ones leave.

    With few vectors there is one fine centroid, at zero. Up to CELLS of either level follow the number of vectors, so
    cells keep their size up to CELLS * CELLS * PER_CELL vectors.
    """

    def __init__(self, x: np.ndarray, n: int):
        if not len(x):
            x = np.eye(1, DIM, dtype=np.float32)
        cells = max(1, n // PER_CELL)
        self.coarse, near = _means(x, min(cells, CELLS, len(x)), True)
        fine = min(-(-cells // CELLS), CELLS, len(x))
        self.fine = _means(x - self.coarse[near], fine, False)[0] if fine > 1 else np.zeros((1, DIM), np.float32)
        self.norm = np.linalg.norm(self.coarse[:, None, :] + self.fine[None, :, :], axis=2) if fine > 1 else np.linalg.norm(self.coarse, axis=1)[:, None]
        self.share = np.bincount(self.near(x, 0.0)[2], minlength=self.norm.size) / len(x)

    def near(self, x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) of the cells within ``most`` of each row's nearest, sorted; and the nearest of each row."""
        s = x @ self.coarse.T
        i, c = np.nonzero(s >= s.max(1, keepdims=True) - most)
        t = (s[i, c][:, None] + (x @ self.fine.T)[i]) / np.maximum(self.norm[c], 1e-6)
        first = np.searchsorted(i, np.arange(len(x)))
        best = np.maximum.reduceat(t.max(1), first) if len(x) else np.zeros(0, np.float32)
        p, j = np.nonzero(t >= best[i][:, None] - most)
        row, cell, score = i[p], c[p] * self.fine.shape[0] + j, t[p, j]
        top = np.lexsort((cell, -score, row))
        return row, cell, cell[top[np.searchsorted(row[top], np.arange(len(x)))]]


def fit(vectors: DataFrame, n: int, bound: int = SAMPLE) -> Cells:
    """Cells fitted on about ``bound`` rows chosen by hash of id; every row is indexed in them."""
    share = min(1.0, bound / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) or 1)).select("id", "embedding").toPandas()
    rows = rows[usable(rows["embedding"])] if len(rows) else rows
    return Cells(unit(np.array(rows.sort_values("id")["embedding"].tolist(), np.float32)).astype(np.float32) if len(rows) else np.zeros((0, DIM), np.float32), n)


def dealt(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below 2^31 from a hash of each id, so that no stride of ids favours a page or a slot."""
    h = ids.astype(np.uint64)
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(k)
    h ^= h >> np.uint64(31)
    return (h >> np.uint64(33)).astype(np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.int64)


def route(vectors: DataFrame, cells: Cells, pages: np.ndarray, slots: np.ndarray, most: float = MARGIN) -> DataFrame:
    """(cell, page, slot, id, indexed, asks, home, v): each vector where it is indexed and where it asks.

    A cell's indexed vectors are dealt to its pages, its askers to its slots; every page meets every slot, so no part
    holds more than its share of either.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((cells, pages, slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, many, wide = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                part = part[usable(part["embedding"])]
                if not len(part):
                    continue
                raw = np.array(part["embedding"].tolist(), np.float32)
                ids = part["id"].to_numpy()
                deal_page, deal_slot = dealt(ids)
                i, cell, home = own.near(unit(raw).astype(np.float32), most)
                i, cell = np.repeat(i, many[cell]), np.repeat(cell, many[cell])
                first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (cell[1:] != cell[:-1])]))
                page = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                at_home = home[i] == cell
                blobs = np.array([r.tobytes() for r in raw], object)
                slot = deal_slot[i] % wide[cell]
                yield pd.DataFrame({"cell": cell, "page": page, "slot": slot, "id": ids[i], "indexed": at_home & (deal_page[i] % many[cell] == page), "asks": True, "home": at_home, "v": blobs[i]})
                # The other slots of its page see an indexed vector too.
                j = np.repeat(np.arange(len(ids)), wide[home])
                slot = np.arange(len(j)) - np.repeat(np.cumsum(wide[home]) - wide[home], wide[home])
                other = slot != deal_slot[j] % wide[home[j]]
                j, slot = j[other], slot[other]
                if len(j):
                    yield pd.DataFrame({"cell": home[j], "page": deal_page[j] % many[home[j]], "slot": slot, "id": ids[j], "indexed": True, "asks": False, "home": True, "v": blobs[j]})

    return vectors.select("id", "embedding").mapInPandas(run, "cell int, page int, slot int, id long, indexed boolean, asks boolean, home boolean, v binary")


def at_least(marks: Iterator[np.ndarray], need: int) -> np.ndarray:
    """The bits set in ``need`` or more of ``marks``, arrays of 64-bit words: sums by carry-save adders, bit by bit."""
    planes: list[list[np.ndarray]] = []

    def add(x: np.ndarray, w: int) -> None:
        while True:
            if w == len(planes):
                planes.append([])
            planes[w].append(x)
            if len(planes[w]) < 3:
                return
            a, b, c = planes[w]
            ab = a ^ b
            planes[w] = [ab ^ c]
            x, w = (a & b) | (ab & c), w + 1

    for m in marks:
        add(m, 0)
    w = 0
    while w < len(planes):
        if len(planes[w]) == 2:
            a, b = planes[w]
            planes[w] = [a ^ b]
            add(a & b, w + 1)
        w += 1
    out = np.full_like(planes[0][0], ~np.uint64(0))
    for w in range(max(len(planes), need.bit_length())):
        bit = planes[w][0] if w < len(planes) else np.zeros_like(out)
        out = bit & out if need >> w & 1 else bit | out
    return out


class Tables:
    """Sorted projections of some vectors on the axes of a random rotation, asked by query-centred windows.

    ``before[t, b]`` marks the vectors in the first b parts of table t, a bit each, so the vectors of a window are the
    difference of two marks, and 64 of them are counted at once.
    """

    def __init__(self, data: np.ndarray, seed: int = 3):
        n, dim = data.shape
        self.n, self.step = n, -(-n // PARTS)
        # Rows of a rotation, as long as those of random normal lines: a difference of length d projects with spread d.
        self.lines = (np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0][:, :TABLES] * np.sqrt(dim)).astype(np.float32)
        p = data @ self.lines
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, 0).T)
        # A window begins in the first part whose last value it reaches and ends in the last whose first it reaches.
        self.first = np.ascontiguousarray(self.sorted[:, :: self.step])
        self.last = np.concatenate([self.first[:, 1:], self.sorted[:, -1:]], 1)
        self.last[:, : n // self.step] = self.sorted[:, self.step - 1 :: self.step]
        words, edges = -(-n // 64), np.arange(-(-n // self.step) + 1)[:, None]
        self.before = np.empty((TABLES, len(edges), words), np.uint64)
        part = np.full(words * 64, len(edges), np.int32)
        for t in range(TABLES):
            part[order[:, t]] = np.arange(n) // self.step
            self.before[t] = np.packbits(part[None, :] < edges, axis=1, bitorder="little").view(np.uint64)

    def _windows(self, q: np.ndarray, width: float) -> Iterator[np.ndarray]:
        p = np.ascontiguousarray((q @ self.lines).T)
        for t in range(TABLES):
            lo = self.last[t].searchsorted(p[t] - width, "left")
            hi = self.first[t].searchsorted(p[t] + width, "right")
            yield self.before[t].take(hi, 0) ^ self.before[t].take(lo, 0)

    def candidates(self, q: np.ndarray, width: float, need: int = NEED) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector): the vectors that at least ``need`` tables hold within ``width`` of the query."""
        got = at_least(self._windows(q, width), need)
        return np.nonzero(np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, : self.n])


def _kth(row: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k``-th largest value of each of ``n`` rows, the least if it has fewer; ``row`` is in order."""
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    if size.max(initial=0) <= k:
        return np.full(n, -np.inf, np.float32)
    wide = np.full((n, size.max()), -np.inf, np.float32)
    wide[row, np.arange(len(row)) - first[row]] = value
    return -np.partition(-wide, k - 1, axis=1)[:, k - 1]


def nearest(ids: np.ndarray, x: np.ndarray, indexed: np.ndarray, asks: np.ndarray, k: int = K, floor: float = FLOOR, guests: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, indexed row, cosine) of the up to ``k`` most similar of each row that asks, ties by smaller id.

    ``guests``, askers at home elsewhere, rarely have ``k`` near ones here, so they open the widest windows at once.
    """
    where = np.flatnonzero(indexed)
    x32, found = x.astype(np.float32), []
    if not len(where):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    t, d32 = Tables(x32[where]), x32[where]
    late = asks & guests if guests is not None else np.zeros(len(ids), bool)
    open_ = np.flatnonzero(asks & ~late)
    for level in LEVELS:
        r, last, still = level * radius(floor), level == LEVELS[-1], []
        if last:
            open_ = np.concatenate([open_, np.flatnonzero(late)])
        for at in range(0, len(open_), block):
            q = open_[at : at + block]
            qi, di = t.candidates(x32[q], WIDTH * r)
            other = ids[q[qi]] != ids[where[di]]
            qi, di = qi[other], di[other]
            sim = np.concatenate([np.einsum("ij,ij->i", x32[q[qi[i : i + 65_536]]], d32[di[i : i + 65_536]]) for i in range(0, len(qi), 65_536)] or [np.zeros(0, np.float32)])
            enough = np.bincount(qi[sim >= 1 - r * r / 2], minlength=len(q)) >= k
            if not last:
                still.append(q[~enough])
                ok = enough[qi]
                qi, di, sim = qi[ok], di[ok], sim[ok]
            ok = sim >= floor - 1e-5
            qi, di, sim = qi[ok], di[ok], sim[ok]
            # The k-th largest of each query, with room for rounding, bounds what is worked out in double precision.
            ok = sim >= _kth(qi, sim, len(q), k)[qi] - 1e-5
            qi, di = q[qi[ok]], where[di[ok]]
            exact = np.round(np.einsum("ij,ij->i", x[qi], x[di]), 6)
            order = np.lexsort((ids[di], -exact, qi))
            qi, di, exact = qi[order], di[order], exact[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
            ok = (place < k) & (exact >= floor)
            found.append((qi[ok], di[ok], exact[ok]))
        if last:
            break
        open_ = np.concatenate(still) if still else open_[:0]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def copies(vectors: DataFrame) -> DataFrame:
    """vectors(id, h1, h2): (id, rep), the ids whose vector another id has too, and the least id of each such group."""
    keyed = vectors.select("id", "h1", "h2")
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(groups, ["h1", "h2"]).select("id", "rep")


def neighbours(entities: DataFrame, k: int = K, floor: float = FLOOR) -> DataFrame:
    """(id, other, cosine, place): the ``k`` most similar others of each id with a cosine of ``floor`` (above 0) or more.

    Equal vectors are searched once, by their least id, and spread again at the end: of a group only its k + 1 least
    ids can be among anyone's k most similar. Null, short, long, zero and non-finite vectors have no neighbours.
    """
    if not 0 < floor < 1:
        raise ValueError("floor must lie between 0 and 1")
    vectors, n = cut(current(entities).select("id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(11), "embedding").alias("h2")))
    same = small(copies(vectors))
    single = vectors.join(same.where("id <> rep").select("id"), "id", "left_anti")
    cells = fit(vectors, n)
    pages = np.maximum(1, np.ceil(cells.share * n / PAGE)).astype(np.int64)
    slots = np.maximum(1, np.ceil(3 * cells.share * n / ASKERS)).astype(np.int64)  # a vector asks some three cells

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, home = pdf["id"].to_numpy(), pdf["home"].to_numpy()
        x = unit(np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(-1, DIM))
        q, d, cosine = nearest(ids, x, pdf["indexed"].to_numpy(), pdf["asks"].to_numpy(), k, floor, ~home)
        back = ~home[q]  # what a guest finds here may not find the guest's home
        return pd.DataFrame({"id": np.concatenate([ids[q], ids[d[back]]]), "other": np.concatenate([ids[d], ids[q[back]]]), "cosine": np.concatenate([cosine, cosine[back]])})

    pairs = route(single, cells, pages, slots, margin(floor)).groupBy("cell", "page", "slot").applyInPandas(search, "id long, other long, cosine double")
    least = same.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("nth") <= k + 1).select("rep", F.col("id").alias("copy"))
    spread = pairs.join(least.withColumnRenamed("rep", "other"), "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "cosine")
    spread = spread.join(same.select(F.col("id").alias("twin"), F.col("rep").alias("id")), "id", "left").select(F.coalesce("twin", "id").alias("id"), "other", "cosine")
    own = same.join(least, "rep").where("id <> copy").select("id", F.col("copy").alias("other"), F.lit(1.0).alias("cosine"))
    place = F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return spread.unionByName(own).withColumn("place", place).where(F.col("place") <= k).dropDuplicates(["id", "other"])


def close_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the other's most similar."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
