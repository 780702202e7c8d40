"""The k most similar vectors of every vector: anisotropic four-bit quantisation, table scans, exact reranking.

Equal vectors are collapsed first (a class keeps its k + 1 smallest keys, which is all that can ever be an answer), so
copies cost nothing. Coarse cells and code books are fitted on at most SAMPLE vectors; every vector is indexed. The code
books minimise the score-aware loss: the part of a residual that is parallel to its vector counts ETA times as much as
the rest, because it is what moves inner products of close pairs.

A query looks into every cell whose centre is nearly as similar as the nearest one. How nearly is calibrated on the
sample: queries are told apart by how similar their nearest centre is, and the margins of these kinds are chosen so that
cells hold TARGET of the sample's true neighbours at the least number of vectors looked at. A vector inside a cluster
then looks into a few cells, and only one that lies apart from all others into many.

For each query and cell the 16-entry tables of all subspaces are summed over the codes, which for the queries of a cell
is one matrix product with what the codes stand for; the best RERANK codes, and all that tie with the last of them, are
scored again with the vectors themselves.

Neighbouring cells form groups of about BLOCK vectors, and a query is sent once to each group it looks into. Groups,
cells of any size included, are cut into blocks of about BLOCK vectors; the queries of a group are cut into blocks by
how many look into it, so a vector is copied only as often as the queries near it need.

Defined results: rows without key or vector, of another length, with missing or non-finite numbers, or all zero are
left out; of several rows of one key the smallest vector counts; similarities are rounded to 6 places and equal ones go
to the smaller key; a table with one vector has no neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.plans.scratch import written

SAMPLE = 20_000  #: vectors the index is fitted on
CELLS = 4096  #: most cells; otherwise eight times the square root of the number of vectors
TARGET, LEAST = 0.91, 8  #: share of true neighbours that the cells looked into hold on the sample; cells looked into at least
KINDS, ASKED = 8, 2000  #: kinds of queries told apart, and sample queries that margins are calibrated with
CODED = 8000  #: vectors of the sample that code books are fitted on
RERANK = 64  #: codes of a block that are scored exactly for a query, besides all that tie with the last of them
TIE = 1e-3  #: scores that differ by less tie
QUERIES = 256  #: queries scanned at once
BLOCK = 16_384  #: vectors, and queries, that one group of a task holds
T = 0.2  #: similarity above which scores matter, see eta()


def eta(dim: int) -> float:
    """Weight of parallel residuals for the score-aware loss with threshold T."""
    return (dim - 1) * T * T / (1 - T * T)


class Quantiser:
    """Coarse cells and, for the residuals, 16 codes in each pair of dimensions."""

    def __init__(self, x: np.ndarray, cells: int, seed: int = 7, rounds: int = 8):
        rng = np.random.default_rng(seed)
        x = np.asarray(x, np.float32)
        self.dim, self.eta = x.shape[1], eta(x.shape[1])
        c = x[rng.permutation(len(x))[: max(1, cells)]].copy()
        for _ in range(rounds):
            cell = self._nearest(x, c)
            n = np.bincount(cell, minlength=len(c))
            order = np.argsort(cell, kind="stable")
            have = np.flatnonzero(n)
            sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[have])[:-1]]), axis=0)
            c[have] = sums / n[have, None]
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c /= np.where(norm > 0, norm, 1)
        self.cells = c
        self.edges, self.margins = np.zeros(0), np.full(1, np.inf)
        self.books = np.zeros((self.dim // 2, 16, 2), np.float32)
        r, d = self._residual(x[rng.permutation(len(x))[:CODED]])
        for m in range(self.dim // 2):
            self.books[m] = self._lloyd(r[:, 2 * m : 2 * m + 2], rng)
        for _ in range(3):
            self._refit(r, d, self._encode(r, d))

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[k : k + 8192] @ c.T, axis=1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)

    @staticmethod
    def _lloyd(r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        c = r[rng.integers(0, len(r), 16)].astype(np.float32)
        for _ in range(8):
            a = np.argmin(((r[:, None] - c) ** 2).sum(2), axis=1)
            n = np.bincount(a, minlength=16)
            for k in (0, 1):
                s = np.bincount(a, r[:, k], minlength=16)
                c[:, k] = np.where(n > 0, s / np.maximum(n, 1), c[:, k])
        return c

    def _residual(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x - self.cells[self._nearest(x, self.cells)], x

    def _encode(self, r: np.ndarray, d: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent on the score-aware loss, all vectors at once."""
        half = self.dim // 2
        code = np.empty((len(r), half), np.int64)
        par = np.zeros(len(r), np.float32)
        for m in range(half):
            e = r[:, None, 2 * m : 2 * m + 2] - self.books[m]
            code[:, m] = np.argmin((e**2).sum(2), axis=1)
            par += ((r[:, 2 * m : 2 * m + 2] - self.books[m][code[:, m]]) * d[:, 2 * m : 2 * m + 2]).sum(1)
        for _ in range(sweeps):
            for m in range(half):
                x = d[:, 2 * m : 2 * m + 2]
                own = ((r[:, 2 * m : 2 * m + 2] - self.books[m][code[:, m]]) * x).sum(1)
                e = r[:, None, 2 * m : 2 * m + 2] - self.books[m]
                p = (par - own)[:, None] + (e * x[:, None]).sum(2)
                code[:, m] = np.argmin((e**2).sum(2) + (self.eta - 1) * p * p, axis=1)
                par = p[np.arange(len(p)), code[:, m]]
        return code

    def _refit(self, r: np.ndarray, d: np.ndarray, code: np.ndarray) -> None:
        err = r - self._decode(code)
        par = (err * d).sum(1)
        for m in range(self.dim // 2):
            rm, x = r[:, 2 * m : 2 * m + 2], d[:, 2 * m : 2 * m + 2]
            own = (err[:, 2 * m : 2 * m + 2] * x).sum(1)
            for j in range(16):
                i = code[:, m] == j
                if i.sum() < 4:
                    continue
                a = i.sum() * np.eye(2) + (self.eta - 1) * x[i].T @ x[i]
                b = rm[i].sum(0) + (self.eta - 1) * (x[i] * ((par - own)[i] + (rm[i] * x[i]).sum(1))[:, None]).sum(0)
                self.books[m, j] = np.linalg.solve(a, b)

    def _decode(self, code: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.dim // 2), code].reshape(len(code), self.dim)

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and packed codes of unit vectors."""
        cell = self._nearest(x, self.cells)
        code = self._encode(x - self.cells[cell], x).astype(np.uint8)
        return cell, code[:, 0::2] | (code[:, 1::2] << 4)

    def table(self, cell: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """What codes stand for in their cells: a query's inner products with these rows are its summed tables."""
        code = np.empty((len(packed), self.dim // 2), np.int64)
        code[:, 0::2], code[:, 1::2] = packed & 15, packed >> 4
        return self.cells[cell] + self._decode(code)

    def grouped(self, sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """A group for each cell: the cells are halved along their main direction until a half has few enough vectors."""
        group, nxt, todo = np.zeros(len(self.cells), np.int64), 0, [np.arange(len(self.cells))]
        while todo:
            c = todo.pop()
            if len(c) == 1 or sizes[c].sum() <= block:
                group[c] = nxt
                nxt += 1
                continue
            x = self.cells[c] - self.cells[c].mean(0)
            o = c[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
            k = int(np.clip(np.searchsorted(np.cumsum(sizes[o]), sizes[o].sum() / 2), 1, len(o) - 1))
            todo += [o[:k], o[k:]]
        return group

    def calibrate(self, x: np.ndarray, k: int = 5, target: float = TARGET, seed: int = 5) -> None:
        """Chooses a margin for each kind of query by the true neighbours of some vectors of the sample in the sample."""
        if target >= 1 or len(x) <= k:
            return
        asked = np.random.default_rng(seed).permutation(len(x))[:ASKED]
        cell = self._nearest(x, self.cells)
        size = np.bincount(cell, minlength=len(self.cells)) / len(x)
        best, miss, cost = [], [], []
        levels = np.concatenate([np.arange(0.3, 0.9, 0.05), np.arange(0.9, 1.0, 0.01), [0.995, 1.0]])
        for lo in range(0, len(asked), 500):
            q = asked[lo : lo + 500]
            sim = x[q] @ x.T
            sim[np.arange(len(q)), q] = -9
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            s = x[q] @ self.cells.T
            best.append(s.max(1))
            miss.append(best[-1][:, None] - np.take_along_axis(s, cell[near], 1))  # what each neighbour asks of the margin
            order = np.argsort(-s, axis=1)
            cost.append((best[-1][:, None] - np.take_along_axis(s, order, 1), np.cumsum(size[order], axis=1)))
        best, miss = np.concatenate(best), np.concatenate(miss)
        gaps, seen = (np.concatenate([c[i] for c in cost]) for i in (0, 1))
        self.edges = np.quantile(best, np.arange(1, KINDS) / KINDS)
        kind = np.digitize(best, self.edges)
        kinds = [np.flatnonzero(kind == j) for j in range(KINDS)]
        margin = np.array([np.quantile(miss[i], levels) if len(i) else np.zeros(len(levels)) for i in kinds]) + 1e-6
        look = lambda i, m: seen[i, np.maximum((gaps[i] <= m).sum(1), 1) - 1].mean() if len(i) else 0.0
        price = np.array([[look(i, m) for m in row] for i, row in zip(kinds, margin)])
        at, weight = np.zeros(KINDS, int), np.array([len(i) for i in kinds]) / len(asked)
        while weight @ levels[at] < target and (at < len(levels) - 1).any():
            # the step that gains most true neighbours for the vectors it makes queries look at
            gain = [(levels[a + 1] - levels[a]) / max(price[j, a + 1] - price[j, a], 1e-9) if a < len(levels) - 1 and weight[j] else -1.0 for j, a in enumerate(at)]
            at[int(np.argmax(gain))] += 1
        self.margins = margin[np.arange(KINDS), at]

    def probes(self, x: np.ndarray, least: int = LEAST) -> np.ndarray:
        """Which cells (columns) each vector looks into."""
        s = x @ self.cells.T
        best = s.max(1)
        out = s >= (best - self.margins[np.digitize(best, self.edges)])[:, None]
        if least < s.shape[1]:
            np.put_along_axis(out, np.argpartition(-s, least - 1, axis=1)[:, :least], True, 1)
        else:
            out[:] = True
        return out


def _unit(col: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(col), np.float32).reshape(-1, dim)
    n = np.linalg.norm(x.astype(np.float64), axis=1)
    return x, (x / n[:, None]).astype(np.float32)


def valid(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vector) with one usable vector per key."""
    v = F.col(vector)
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & ok).groupBy(F.col(key).alias("key")).agg(F.min(v).alias("vector"))


def neighbours(vectors: DataFrame, key: str, vector: str, dim: int, k: int = 5, target: float = TARGET) -> DataFrame:
    """(key, neighbour, similarity, place): the k nearest others of every key; with target 1 every cell is looked into."""
    spark = vectors.sparkSession
    rows = valid(vectors, key, vector, dim).withColumn("id", F.xxhash64("vector"))
    first = Window.partitionBy("id").orderBy("key")
    kept = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    kept = kept.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.first("vector").alias("vector"))

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "keys": b["keys"], "vec": [np.asarray(v, np.float32).tobytes() for v in b["vector"]]})

    kept = written(kept.mapInPandas(pack, "id long, keys array<string>, vec binary"), "knn-classes")
    n = kept.count()
    if n == 0:
        return spark.createDataFrame([], "key string, neighbour string, similarity double, place int")
    sample = kept.select("vec")
    if n > SAMPLE:
        sample = kept.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
    sampled = _unit(sample.toPandas()["vec"], dim)[1]
    fitted = Quantiser(sampled, min(CELLS, int(8 * n**0.5) or 1, max(1, len(sampled) // 4)))
    fitted.calibrate(sampled, k, target)
    shared = spark.sparkContext.broadcast(fitted)

    def encode(batches):
        q = shared.value
        for b in batches:
            if len(b):
                x, u = _unit(b["vec"], dim)
                cell, packed = q.index(u)
                yield pd.DataFrame({"id": b["id"], "first_key": [y[0] for y in b["keys"]], "vec": b["vec"], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in packed]})

    coded = written(kept.mapInPandas(encode, "id long, first_key string, vec binary, cell int, codes binary"), "knn-codes")
    sizes = np.zeros(len(fitted.cells), np.int64)
    for r in coded.groupBy("cell").count().collect():  # one row a cell, CELLS at most
        sizes[r["cell"]] = r["count"]
    groups = fitted.grouped(sizes)

    def ask(batches):
        fit = shared.value
        for b in batches:
            if len(b):
                look = fit.probes(_unit(b["vec"], dim)[1])
                for g in range(groups.max() + 1):
                    mine = np.flatnonzero(groups == g)
                    part = look[:, mine]
                    rows = np.flatnonzero(part.any(1))
                    if len(rows):
                        yield pd.DataFrame({"id": b["id"].to_numpy()[rows], "vec": b["vec"].to_numpy()[rows], "grp": np.int32(g), "codes": [mine[x].astype(np.uint16).tobytes() for x in part[rows]]})

    asked = coded.select("id", "vec").mapInPandas(ask, "id long, vec binary, grp int, codes binary")
    held = np.bincount(groups, sizes)
    nd = F.element_at(F.array(*(F.lit(int(-(-h // BLOCK)) or 1) for h in held)), F.col("grp") + 1)
    look = fitted.probes(sampled[:ASKED])
    asking = np.array([look[:, groups == g].any(1).mean() for g in range(groups.max() + 1)])  # share of queries that look into a group
    nq = F.element_at(F.array(*(F.lit(max(1, int(-(-x * n // BLOCK)))) for x in asking)), F.col("grp") + 1)
    grp = F.element_at(F.array(*map(F.lit, map(int, groups))), F.col("cell") + 1)
    upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    mine = lambda c: F.pmod(F.shiftright("id", 7), c).cast("int")
    data = coded.select(grp.alias("grp"), "cell", "id", "first_key", "vec", "codes").select("grp", mine(nd).alias("d"), upto(nq).alias("q"), "cell", "id", "first_key", "vec", "codes")
    query = asked.select("grp", upto(nd).alias("d"), mine(nq).alias("q"), F.lit(-1).alias("cell"), "id", F.lit(None).cast("string").alias("first_key"), "vec", "codes")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = shared.value
        d, q = pdf[pdf["cell"] >= 0], pdf[pdf["cell"] < 0]
        out = {"id": [], "other": [], "similarity": [], "first_key": []}
        if len(d) and len(q):
            d = d.sort_values("first_key")  # places in d then stand for keys in every tie
            dv, du = _unit(d["vec"], dim)
            qv, qu = _unit(q["vec"], dim)
            packed = np.frombuffer(b"".join(d["codes"]), np.uint8).reshape(len(d), -1)
            cell = d["cell"].to_numpy()
            table = fit.table(cell, packed).T.copy()
            look = np.zeros((len(q), len(fit.cells)), bool)
            lists = [np.frombuffer(c, np.uint16) for c in q["codes"]]
            look[np.repeat(np.arange(len(q)), [len(x) for x in lists]), np.concatenate(lists)] = True
            by = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[by], return_index=True)
            spans = list(zip(cells, starts, [*starts[1:], len(by)]))
            d64 = dv.astype(np.float64)
            d64 /= np.linalg.norm(d64, axis=1, keepdims=True)
            ids, dids, keys = q["id"].to_numpy(), d["id"].to_numpy(), d["first_key"].to_numpy()
            top = min(RERANK, len(d))
            q64 = qv.astype(np.float64)
            q64 /= np.linalg.norm(q64, axis=1, keepdims=True)
            for s in range(0, len(q), QUERIES):
                scores = np.full((len(qu[s : s + QUERIES]), len(d)), -9, np.float32)
                for c, lo, hi in spans:
                    rows_ = np.flatnonzero(look[s : s + QUERIES, c])
                    if len(rows_):
                        scores[rows_[:, None], by[lo:hi]] = qu[s + rows_] @ table[:, by[lo:hi]]
                last = -np.partition(-scores, top - 1, axis=1)[:, top - 1]  # the last of the best RERANK
                who, what = np.nonzero(scores >= np.maximum(last - TIE, -8)[:, None])
                sim = np.round(np.einsum("rd,rd->r", q64[s + who], d64[what]), 6)
                other = dids[what] != ids[s + who]
                who, what, sim = who[other], what[other], sim[other]
                o = np.lexsort((what, -sim, who))
                who, what, sim = who[o], what[o], sim[o]
                hit = np.arange(len(who)) - np.searchsorted(who, who, side="left") < k
                out["id"].append(ids[s + who[hit]])
                out["other"].append(dids[what[hit]])
                out["similarity"].append(sim[hit])
                out["first_key"].append(keys[what[hit]])
        empty = {"id": np.int64, "other": np.int64, "similarity": np.float64, "first_key": object}
        return pd.DataFrame({c: np.concatenate(v) if v else np.array([], empty[c]) for c, v in out.items()})

    hits = data.unionByName(query).groupBy("grp", "d", "q").applyInPandas(scan, "id long, other long, similarity double, first_key string")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "first_key")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    # per class: its own keys at similarity 1 and those of its k nearest classes
    keys = kept.select(F.col("id").alias("other"), "keys")
    near = hits.join(keys, "other").select("id", F.explode("keys").alias("neighbour"), "similarity")
    near = near.unionByName(kept.select("id", F.explode("keys").alias("neighbour"), F.lit(1.0).alias("similarity")))
    near = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, 2 * k + 2).alias("near"))
    out = rows.select("id", "key").join(near, "id")
    out = out.select("key", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), 1, k)).alias("place", "x"))
    return out.select("key", F.col("x.neighbour").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("place") + 1).cast("int").alias("place"))


def pairs(vectors: DataFrame, key: str, vector: str, dim: int, k: int = 5) -> DataFrame:
    """Unordered pairs (key_a, key_b) in which one is among the k nearest of the other."""
    n = neighbours(vectors, key, vector, dim, k)
    return n.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
