"""Dense kernels over worlds: semidefiniteness, observability, stability, sampling, scan registration.

Worlds are small and dense; what grows is their number, and they are independent. A world's cells become one row, and NumPy
takes all worlds of a batch that have the same number of variables in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Diagonal shifts tried in turn by the Cholesky factorization, relative to the mean variance (at least 1).
JITTER = (0.0, 1e-12, 1e-10)


def matrix(pdf: pd.DataFrame, rows: str = "i", cols: str = "k", value: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """The sorted variables of a world and its dense matrix."""
    names = np.unique(np.concatenate((pdf[rows].to_numpy(), pdf[cols].to_numpy())))
    m = np.zeros((len(names), len(names)))
    np.add.at(m, (np.searchsorted(names, pdf[rows]), np.searchsorted(names, pdf[cols])), pdf[value].to_numpy())
    return names, m


#: Arrow types of the kernels' columns.
TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def worlds(cells: DataFrame, kernel: Callable[[np.ndarray, list[np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, parts: int = 1) -> DataFrame:
    """What ``kernel`` makes of worlds of equal size: their numbers, the matrices of each part, and their variables in order.

    cells (world, i, k, v, part), part from 0 on; a cell of a vector has no k and stands in the first column of its part.
    Cells are small and kernels slow, so worlds are dealt over as many tasks as a shuffle has partitions, however few bytes they take.
    """
    spread = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "world")
    return packed(spread.groupBy("world").agg(F.collect_list(F.struct("i", "k", "v", "part")).alias("c")), kernel, schema, parts)


def packed(rows: DataFrame, kernel: Callable[[np.ndarray, list[np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, parts: int = 1) -> DataFrame:
    """:func:`worlds` of rows (world, c) that hold a world's cells as an array of (i, k, v, part)."""
    rows = rows.select("world", *(F.col(f"c.{n}").alias(n) for n in ("i", "k", "v", "part")))
    arrow = pa.schema([(n, TYPES[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, count = batch["world"].to_numpy(zero_copy_only=False), batch.num_rows
            at = np.repeat(np.arange(count), pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False))
            i, k, v, part = (batch[n].flatten() for n in ("i", "k", "v", "part"))
            single, v, part = k.is_null().to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False), part.to_numpy(zero_copy_only=False)
            both = pa.concat_arrays([i, pc.coalesce(k, i)]).dictionary_encode()
            order = pc.sort_indices(both.dictionary).to_numpy()
            names, code = both.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False), np.argsort(order)[both.indices.to_numpy()]
            row, col = (at * len(names) + x for x in (code[: len(i)], code[len(i) :]))
            slots = np.unique(np.concatenate((row[~single], col[~single])))
            # a world's variables are those of its matrices; what a vector says of others is left out
            known = np.isin(row, slots)
            at, v, part, single, row, col = (x[known] for x in (at, v, part, single, row, col))
            owner = slots // len(names)
            first, size = np.searchsorted(owner, np.arange(count)), np.bincount(owner, minlength=count)
            r, c = np.searchsorted(slots, row) - first[at], np.where(single, 0, np.searchsorted(slots, col) - first[at])
            for n in np.unique(size[size > 0]):
                mine = np.flatnonzero(size == n)
                place = np.full(count, -1)
                place[mine] = np.arange(len(mine))
                m = []
                for x in range(parts):
                    some = (size[at] == n) & (part == x)
                    m.append(np.zeros((len(mine), n, n)))
                    np.add.at(m[-1], (place[at[some]], r[some], c[some]), v[some])
                out = kernel(ids[mine], m, names[slots[first[mine][:, None] + np.arange(n)] % len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(out[t.name], len(out["world"])), t.type) for t in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def symmetric(m: np.ndarray) -> np.ndarray:
    """The symmetric part of matrices of finite numbers."""
    if not np.isfinite(m).all():
        raise ValueError("the matrix has entries that are not finite")
    return (m + m.swapaxes(-1, -2)) / 2


def _shifted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric parts, and the shifts that their least eigenvalues ask for (NaN: none is enough)."""
    values, vectors = np.linalg.eigh(symmetric(m))
    n = values.shape[-1]
    if not n:
        return values, vectors, np.zeros(values.shape[:-1])
    unit = np.maximum(values.sum(-1) / n, 1.0)
    least = values[..., 0] - n * np.finfo(float).eps * np.maximum(values[..., -1], 0.0)
    shift = np.full(unit.shape, np.nan)
    for j in reversed(JITTER):
        shift = np.where(least + j * unit > 0, j * unit, shift)
    return values, vectors, shift


def factor(m: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Lower triangular factors of semidefinite matrices, and the diagonal shifts that their least eigenvalues ask for.

    A factor comes from the eigenvectors, stretched by the roots of the shifted eigenvalues, by one QR step. A least
    eigenvalue below the last shift is an error.
    """
    values, vectors, shift = _shifted(m)
    if np.isnan(shift).any():
        raise np.linalg.LinAlgError("the covariance is not positive semidefinite")
    upper = np.linalg.qr((vectors * np.sqrt(values + shift[..., None])[..., None, :]).swapaxes(-1, -2), mode="r")
    sign = np.where(np.diagonal(upper, axis1=-2, axis2=-1) < 0, -1.0, 1.0)
    return (upper * sign[..., None]).swapaxes(-1, -2), shift if shift.ndim else float(shift)


def _cells(cov: DataFrame, part: int = 0) -> DataFrame:
    return cov.select("world", "i", "k", "v", F.lit(part).alias("part"))


def _vector(rows: DataFrame, value: str, part: int = 1) -> DataFrame:
    return rows.select("world", "i", F.lit(None).cast("string").alias("k"), F.col(value).alias("v"), F.lit(part).alias("part"))


def solve(cov: DataFrame, rhs: DataFrame) -> DataFrame:
    """(world, i, x): the solution of each world's system with its covariance (world, i, k, v) and right side (world, i, y)."""

    def kernel(world: np.ndarray, m: list[np.ndarray], names: np.ndarray) -> dict:
        low = factor(m[0])[0]
        x = np.linalg.solve(low.swapaxes(-1, -2), np.linalg.solve(low, m[1][:, :, :1]))
        return {"world": np.repeat(world, names.shape[1]), "i": names.ravel(), "x": x.ravel()}

    return worlds(_cells(cov).unionByName(_vector(rhs, "y")), kernel, "world long, i string, x double", 2)


def _semidefinite(world: np.ndarray, m: list[np.ndarray], names: np.ndarray) -> dict:
    shift = _shifted(m[0])[2]
    return {"world": world, "n": names.shape[1], "jitter": shift, "psd": ~np.isnan(shift)}


PSD = "world long, n int, jitter double, psd boolean"


def psd(cov: DataFrame) -> DataFrame:
    """(world, n, jitter, psd): whether each world's covariance is semidefinite."""
    return worlds(_cells(cov), _semidefinite, PSD)


def checked(rows: DataFrame, tol: float) -> DataFrame:
    """(world, i, k, d, jitter, psd) of rows (world, cov) that hold a world's cells (i, k, v) as an array: one row a world as :func:`psd`
    has it, without i and k, and one for each i < k whose two sides are more than ``tol`` apart, by d."""

    def kernel(world: np.ndarray, m: list[np.ndarray], names: np.ndarray) -> dict:
        found = _semidefinite(world, m, names)
        gap = np.triu(np.abs(m[0] - m[0].swapaxes(-1, -2)), 1)
        at, i, k = np.nonzero(gap > tol)
        none = np.full(len(world), None)
        pair = {"world": world[at], "i": names[at, i], "k": names[at, k], "d": gap[at, i, k], "jitter": found["jitter"][at], "psd": found["psd"][at]}
        whole = {"world": world, "i": none, "k": none, "d": np.zeros(len(world)), "jitter": found["jitter"], "psd": found["psd"]}
        return {n: np.concatenate((whole[n], pair[n])) for n in whole}

    cells = rows.select("world", F.transform("cov", lambda x: x.withField("part", F.lit(0))).alias("c"))
    return packed(cells, kernel, "world long, i string, k string, d double, jitter double, psd boolean")


def _gained(world: np.ndarray, p: np.ndarray, q: np.ndarray, rtol: float) -> dict:
    gain = np.linalg.inv(q) - np.linalg.inv(p)
    lam = np.linalg.eigvalsh((gain + gain.swapaxes(-1, -2)) / 2)
    diag = lambda x: np.diagonal(x, axis1=-2, axis2=-1)
    return {"world": world, "informed": (diag(gain) > rtol / diag(p)).sum(-1), "rank": (lam > 1e-10 * np.maximum(np.abs(lam).max(-1), 1e-300)[:, None]).sum(-1)}


def observability(prior: DataFrame, posterior: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """(world, informed, rank): from the information gained, the inverse covariance less the prior's.

    prior and posterior are covariances (world, i, k, v) over the same variables.
    """
    return worlds(_cells(prior).unionByName(_cells(posterior, 1)), lambda world, m, _: _gained(world, m[0], m[1], rtol), "world long, informed int, rank int", 2)


def observability_of(prior: DataFrame, row: DataFrame, seen: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """:func:`observability` of one measurement a world, of gradient row (world, i, h) and seen (world, noise).

    The posterior, which is full although the prior is sparse, is made in the kernel and never listed. A world without a
    measurement gains nothing.
    """
    noisy = row.join(seen.select("world", "noise"), "world", "left").select("world", "i", F.explode(F.array(F.struct(F.col("h").alias("v"), F.lit(1).alias("part")), F.struct(F.col("noise").alias("v"), F.lit(2).alias("part")))).alias("s"))
    cells = _cells(prior).unionByName(noisy.select("world", "i", F.lit(None).cast("string").alias("k"), "s.v", "s.part").filter("v IS NOT NULL"))

    return worlds(cells, _measured(rtol), "world long, informed int, rank int", 3)


def observability_packed(rows: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """:func:`observability_of` of rows (world, c), c the cells (i, k, v, part) of prior (part 0), gradient (1) and noise (2)."""
    return packed(rows, _measured(rtol), "world long, informed int, rank int", 3)


def _measured(rtol: float) -> Callable[[np.ndarray, list[np.ndarray], np.ndarray], dict]:
    def kernel(world: np.ndarray, m: list[np.ndarray], names: np.ndarray) -> dict:
        h, noise = m[1][:, :, 0], m[2][:, :, 0].max(-1)
        g = np.einsum("wik,wk->wi", m[0], h)
        s = (h * g).sum(-1) + noise
        if ((s <= 1e-300) & (np.abs(h).max(-1) > 0) & (noise > 0)).any():
            raise ValueError("a redundant exact observation: the innovation has no variance")
        less = np.where((noise > 0)[:, None, None], g[:, :, None] * g[:, None, :] / np.where(s > 0, s, 1.0)[:, None, None], 0.0)
        return _gained(world, m[0], m[0] - less, rtol)

    return kernel


def stability(step: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(world, largest, kind): the largest singular value of each world's step matrix (world, i, k, v)."""
    return worlds(_cells(step), _largest(tol), "world long, largest double, kind string")


def stability_packed(rows: DataFrame, tol: float = 1e-9) -> DataFrame:
    """:func:`stability` of rows (world, c), c the cells (i, k, v, part) of the step matrix, part being 0."""
    return packed(rows, _largest(tol), "world long, largest double, kind string")


def _largest(tol: float) -> Callable[[np.ndarray, list[np.ndarray], np.ndarray], dict]:
    def kernel(world: np.ndarray, m: list[np.ndarray], names: np.ndarray) -> dict:
        top = np.linalg.svd(m[0], compute_uv=False).max(-1)
        return {"world": world, "largest": top, "kind": np.where(top < 1 - tol, "contracting", np.where(top > 1 + tol, "amplifying", "marginal")).astype(object)}

    return kernel


def sample_worlds(mean: DataFrame, cov: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(world, draw, i, x): draws from each world's belief; the stream is seeded by the world."""
    return worlds(_cells(cov).unionByName(_vector(mean, "mu")), _drawn(n, seed), DRAWS, 2)


def sample_packed(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """:func:`sample_worlds` of rows (world, c), c the cells (i, k, v, part) of covariance (part 0) and mean (1)."""
    return packed(rows, _drawn(n, seed), DRAWS, 2)


DRAWS = "world long, draw int, i string, x double"


def _drawn(n: int, seed: int) -> Callable[[np.ndarray, list[np.ndarray], np.ndarray], dict]:
    def kernel(world: np.ndarray, m: list[np.ndarray], names: np.ndarray) -> dict:
        low, size = factor(m[0])[0], names.shape[1]
        z = np.stack([np.random.default_rng([seed, int(x) & 0xFFFFFFFF]).standard_normal((n, size)) for x in world])
        x = m[1][:, None, :, 0] + z @ low.swapaxes(-1, -2)
        return {"world": np.repeat(world, n * size), "draw": np.tile(np.repeat(np.arange(n), size), len(world)), "i": np.repeat(names[:, None, :], n, axis=1).ravel(), "x": x.ravel()}

    return kernel


def sample_report(draws: DataFrame, limits: DataFrame) -> DataFrame:
    """(i, n, violated, rate, se): how often draws fall under limits (i, least), worst first."""
    d = draws.join(limits, "i")
    r = d.groupBy("i").agg(F.count("*").alias("n"), F.count_if(F.col("x") < F.col("least")).alias("violated"))
    rate = F.col("violated") / F.col("n")
    return r.withColumns({"rate": rate, "se": F.sqrt(rate * (1 - rate) / F.col("n"))}).orderBy(F.desc("rate"), "i")


def register(points: DataFrame, model: DataFrame, starts: int = 8, coarse: float = 0.08, fine: float = 0.03, outliers: float = 0.05, rounds: int = 25) -> DataFrame:
    """(scan, dx, dy, dz, yaw, nll): the pose that brings each scan's points (scan, x, y, z) onto the model's primitives.

    Expectation-maximization on a mixture of the primitives (px, py, pz, w) and uniform outliers, from several yaws, with
    a wide and then a narrow spread; the M-step is the weighted rigid fit in closed form (yaw and translation). The model
    is one building's primitives: it is collected behind a check of its size.
    """
    most = 20_000
    rows = model.select("px", "py", "pz", "w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a model has at most {most} primitives")
    q, w = np.array([r[:3] for r in rows], float), np.array([r[3] for r in rows], float)
    w = w / w.sum()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy(float)
        best = (np.inf, np.zeros(3), 0.0)
        volume = float(np.prod(np.maximum(np.ptp(np.vstack((x, q)), axis=0), 1e-3)))
        for start in range(starts):
            yaw = 2 * np.pi * start / starts
            r = _yaw(yaw)
            t = q.mean(0) - r @ x.mean(0)
            nll = np.inf
            for k in range(2 * rounds):
                sd = coarse if k < rounds else fine
                y = x @ r.T + t
                d2 = ((y[:, None, :] - q[None, :, :]) ** 2).sum(2)
                dens = (1 - outliers) * w * np.exp(-d2 / (2 * sd**2)) / (2 * np.pi * sd**2) ** 1.5
                total = dens.sum(1) + outliers / volume
                nll = float(-np.log(total).mean())
                g = dens / total[:, None]
                mass = g.sum()
                if mass < 1e-12:
                    break
                a, b = (g.sum(1) @ x) / mass, (g.sum(0) @ q) / mass
                target = g @ q
                xc = x - a
                s = (xc[:, 0] * (target[:, 1] - g.sum(1) * b[1]) - xc[:, 1] * (target[:, 0] - g.sum(1) * b[0])).sum()
                c = (xc[:, 0] * (target[:, 0] - g.sum(1) * b[0]) + xc[:, 1] * (target[:, 1] - g.sum(1) * b[1])).sum()
                yaw = float(np.arctan2(s, c))
                r = _yaw(yaw)
                t = b - r @ a
            if nll < best[0]:
                best = (nll, t, yaw)
        return pd.DataFrame({"scan": [pdf["scan"].iloc[0]], "dx": [best[1][0]], "dy": [best[1][1]], "dz": [best[1][2]], "yaw": [best[2]], "nll": [best[0]]})

    return points.groupBy("scan").applyInPandas(fit, "scan long, dx double, dy double, dz double, yaw double, nll double")


def _yaw(a: float) -> np.ndarray:
    return np.array([[np.cos(a), -np.sin(a), 0.0], [np.sin(a), np.cos(a), 0.0], [0.0, 0.0, 1.0]])


def descend(worlds: DataFrame, objective, x0: str, schema: str, steps: int = 100, armijo: float = 1e-4) -> DataFrame:
    """Gradient descent with backtracking per world: objective(row, x) gives a value and a gradient; ``x0`` is an array column."""

    def run(it):
        for pdf in it:
            xs, values = [], []
            for row in pdf.itertuples(index=False):
                x, rate = np.array(getattr(row, x0), float), 1.0
                f, g = objective(row, x)
                for _ in range(steps):
                    while rate > 1e-12 and objective(row, x - rate * g)[0] > f - armijo * rate * (g @ g):
                        rate *= 0.5
                    if rate <= 1e-12 or g @ g < 1e-20:
                        break
                    x = x - rate * g
                    f, g = objective(row, x)
                    rate *= 1.5
                xs.append(x.tolist())
                values.append(f)
            yield pdf.assign(x=xs, value=values)

    return worlds.mapInPandas(run, schema)
