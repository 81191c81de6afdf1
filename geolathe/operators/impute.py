"""Missing numbers and classes of buildings, filled from comparable buildings and from the same building at another time.

Numbers: a mixed-effects model on the logarithm. Class and release are fixed effects, site and site-by-class random ones; all are
fitted together: the rows are summed to cells of site, class and release, each site adds its part of the generalised
least-squares equations with its random effects absorbed, and the variances come from a few EM rounds. The building itself
is a further random effect, so a value from another release of the same building comes through almost unshrunk. Where
one of height and floors is known, the model runs on the logarithm of height per floor. Classes: a multinomial logit on
footprint, height and floors with the site's class shares, shrunk to those of all sites, as its group effect. Every filled
value has its mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.session import materialize, ship

HEIGHT = (1.0, 300.0)
FLOORS = (1.0, 60.0)
UNKNOWN = "(unknown)"


def real_value(c: Column, bounds: tuple[float, float]) -> Column:
    """The value, or NULL if it is absent or stands in for an absent one: NULL, NaN, infinite, out of bounds."""
    return F.when(~F.isnan(c) & (c >= bounds[0]) & (c <= bounds[1]), c)


def footprint(geom: Column) -> Column:
    """Area of the first ring by the shoelace sum; NULL without one."""
    ring = F.get(geom, F.lit(0))
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))) / 2)


def clean(buildings: DataFrame) -> DataFrame:
    """One row per (id, release): of repeated rows the last delivered, ties by value. Numbers out of bounds are NULL."""
    ordered = F.struct(
        F.col("ingested_at"), F.col("updated_at"), F.col("site"), F.col("class"),
        real_value(F.col("height").cast("double"), HEIGHT).alias("height"), real_value(F.col("num_floors").cast("double"), FLOORS).alias("num_floors"), footprint(F.col("geom")).alias("area"),
    )
    return buildings.groupBy("id", "release").agg(F.max(ordered).alias("r")).select("id", "release", "r.site", "r.class", "r.height", "r.num_floors", "r.area")


FIT_ROWS = 20_000  # about so many rows with a class, taken by hash, fit the logit; the site shares are of all rows
STRENGTH = 5.0  # rows of prior weight for the shares of a site
STEPS = (42, 18, 13)  # half octaves of area, height and floors; the first of each is "missing"
BASE = ["id", "release", "site", "class", "height", "num_floors", "area"]


def _steps(area, height, floors) -> np.ndarray:
    """Row numbers of the coefficients for each value: one of each of the three scales."""
    out, at = [], 0
    for v, n in zip((area, height, floors), STEPS):
        v = np.asarray(v, float)
        ok = np.isfinite(v) & (v > 0)
        k = np.zeros(len(v), np.int64)
        k[ok] = np.clip(np.floor(2 * np.log2(np.maximum(v[ok], 1e-9))), 0, n - 2).astype(np.int64) + 1
        out.append(k + at)
        at += n
    return np.stack(out, 1)


def fit_logit(x: np.ndarray, y: np.ndarray, offset: np.ndarray, *, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients of a multinomial logit: classes y on one-hot rows x, with known offsets, by accelerated gradient steps on the penalised likelihood."""
    n, k = offset.shape
    w = v = np.zeros((sum(STEPS), k))
    own = np.zeros((n, k))
    own[np.arange(n), y] = 1.0
    # Each coefficient steps by its own curvature bound: at most 3 scales, 1/2 per row that holds it.
    step = 1.0 / (x.shape[1] * 0.5 * np.bincount(x.ravel(), minlength=len(w)) + ridge)[:, None]
    for t in range(rounds):
        s = offset + v[x].sum(1)
        s = np.exp(s - s.max(1, keepdims=True))
        g = own - s / s.sum(1, keepdims=True)
        grad = -ridge * v
        for j in range(x.shape[1]):
            for c in range(k):
                grad[:, c] += np.bincount(x[:, j], g[:, c], minlength=len(w))
        new = v + step * grad
        v = new + t / (t + 3.0) * (new - w)
        w = new
    return w


def _site_scores(counts: list[dict | None], classes: list[str], prior: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Logarithms of the class shares of each row's site, shrunk to the prior; own: the row's class, which does not count for itself."""
    at = {c: i for i, c in enumerate(classes)}
    n = np.zeros((len(counts), len(classes)))
    for i, m in enumerate(counts):
        for c, v in (m.items() if isinstance(m, dict) else m or ()):
            n[i, at[c]] = v
    if own is not None:
        n[np.arange(len(n)), own] -= 1
    return np.log(n + STRENGTH * prior) - np.log(n.sum(1, keepdims=True) + STRENGTH)


def fill_class(rows: DataFrame) -> DataFrame:
    """Adds `class_filled` and `is_class_filled`: the most probable class given site, footprint, height and floors. Collects the class counts and about FIT_ROWS rows."""
    known, empty = rows.where(F.col("class").isNotNull()), rows.where(F.col("class").isNull())
    total = {r["class"]: r["n"] for r in known.groupBy("class").agg(F.count("*").alias("n")).collect()}
    done = known.select(*BASE, F.col("class").alias("class_filled"), F.lit(False).alias("is_class_filled"))
    if not total:
        return done.unionByName(empty.select(*BASE, F.col("class").alias("class_filled"), F.lit(False).alias("is_class_filled")))
    classes = sorted(total)
    n = sum(total.values())
    prior = np.array([(total[c] + 1) / (n + len(classes)) for c in classes])
    # One row a site: its classes and their counts, as many as there are classes.
    shares = materialize(known.groupBy("site", "class").agg(F.count("*").alias("m")).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("class", "m"))).alias("counts")), "shares")
    rate = min(1.0, FIT_ROWS / n)
    some = known.where(F.pmod(F.xxhash64("id", "release"), F.lit(1_000_000)) < int(rate * 1_000_000)) if rate < 1 else known
    fit = some.join(shares, "site", "left").select("class", "area", "height", "num_floors", "counts").toPandas()
    y = np.array([classes.index(c) for c in fit["class"]], np.int64)
    w = fit_logit(_steps(fit["area"], fit["height"], fit["num_floors"]), y, _site_scores(list(fit["counts"]), classes, prior, y)) if len(fit) else np.zeros((sum(STEPS), len(classes)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _site_scores(b.column("counts").to_pylist(), classes, prior)
            s += w[_steps(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("area", "height", "num_floors")))].sum(1)
            best = pa.array(classes, pa.string()).take(pa.array(s.argmax(1) if len(s) else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in BASE), best, pa.array([True] * len(b), pa.bool_())], names=[*BASE, "class_filled", "is_class_filled"])

    filled = empty.join(shares, "site", "left").select(*BASE, "counts").mapInArrow(score, done.schema)
    return done.unionByName(filled)


TARGETS = ("lh", "lf", "lr")  # logarithms of height, floors and height per floor
ROUNDS = 2  # of EM for the variances


class _Site:
    """A site's cells for one target: their mean values, and the inverse covariance with the site and site-by-class effects absorbed."""

    def __init__(self, cls, rel, n, s, p: int, classes: int, var: tuple[float, float, float]):
        within, site, both = var
        self.cls, self.var, self.mean = cls, var, s / n
        self.x = np.zeros((len(n), p))
        self.x[:, 0] = self.x[np.arange(len(n)), 1 + cls] = self.x[np.arange(len(n)), 1 + classes + rel] = 1.0
        self.inv = np.linalg.inv(np.diag(within / n) + site + both * (cls[:, None] == cls[None, :]))

    def equations(self) -> tuple[np.ndarray, np.ndarray]:
        xv = self.x.T @ self.inv
        return xv @ self.x, xv @ self.mean

    def effects(self, beta: np.ndarray):
        """The site's effect, its classes' effects and the sums EM needs: squares and counts of both."""
        _, site, both = self.var
        r = self.inv @ (self.mean - self.x @ beta)
        u = site * r.sum()
        sums = np.array([u * u + site - site * site * self.inv.sum(), 1.0, 0.0, 0.0])
        v = {}
        for c in np.unique(self.cls):
            e = self.cls == c
            v[int(c)] = both * r[e].sum()
            sums[2] += v[int(c)] ** 2 + both - both * both * self.inv[np.ix_(e, e)].sum()
            sums[3] += 1.0
        return u, v, sums


def cell_effects(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(site, cls, release, p_lh, p_lf, p_lr), what the model says for each cell, and the number of known values of each target.

    rows: site, cls, release and the targets. Collects the classes and releases, which are vocabularies, and sums over sites of
    as many numbers; a site's cells, at most classes times releases, are one row.
    """
    stats = [x for y in TARGETS for x in (F.count(y).alias(f"n_{y}"), F.coalesce(F.sum(y), F.lit(0.0)).alias(f"s_{y}"), F.coalesce(F.sum(F.col(y) ** 2), F.lit(0.0)).alias(f"q_{y}"))]
    cells = rows.groupBy("site", "cls", "release").agg(*stats)
    sites = materialize(cells.groupBy("site").agg(F.collect_list(F.struct("cls", "release", *[f"{k}_{y}" for y in TARGETS for k in "nsq"])).alias("cells")), "sites")
    seen = sites.select(F.explode("cells").alias("c")).agg(F.collect_set("c.cls").alias("cls"), F.collect_set("c.release").alias("release")).first()
    classes, releases = sorted(seen["cls"]), sorted(seen["release"])
    p = 1 + len(classes) + len(releases)
    ci, ri = ({v: i for i, v in enumerate(x)} for x in (classes, releases))

    def arrays(row):
        get = lambda k: np.array([c[k] for c in row], float)
        return np.array([ci[c["cls"]] for c in row]), np.array([ri[c["release"]] for c in row]), {f"{k}_{y}": get(f"{k}_{y}") for y in TARGETS for k in "nsq"}

    def block(row, y: str, var) -> _Site | None:
        cls, rel, a = row
        ok = a[f"n_{y}"] > 0
        return _Site(cls[ok], rel[ok], a[f"n_{y}"][ok], a[f"s_{y}"][ok], p, len(classes), var[y]) if ok.any() else None

    def total(of, width: int) -> dict[str, np.ndarray]:
        """Sums of the vectors that of(site's arrays, target) gives."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = np.zeros((len(TARGETS), width))
                for row in map(arrays, b.column("cells").to_pylist()):
                    for k, y in enumerate(TARGETS):
                        if (v := of(row, y)) is not None:
                            out[k] += v
                yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = [r["v"] for r in sites.mapInArrow(run, "v array<double>").collect()]
        return dict(zip(TARGETS, np.sum(parts, axis=0).reshape(len(TARGETS), width) if parts else np.zeros((len(TARGETS), width))))

    def moments(row, y):
        n, s, q = (row[2][f"{k}_{y}"] for k in "nsq")
        ok = n > 0
        return np.array([n.sum(), s.sum(), q.sum(), (q[ok] - s[ok] ** 2 / n[ok]).sum(), ok.sum()])

    m = total(moments, 5)
    var = {}
    for y in TARGETS:
        n, s, q, w, k = m[y]
        spread = max(q / n - (s / n) ** 2, 1e-6) if n else 1.0
        var[y] = (max(w / max(n - k, 1), 1e-6), 0.1 * spread, 0.1 * spread)

    def solve() -> dict[str, np.ndarray]:
        def of(row, y):
            if b := block(row, y, var):
                a, r = b.equations()
                return np.concatenate([a.ravel(), r])

        t = total(of, p * p + p)
        # The level of classes and releases is free against the mean; a weak ridge settles it.
        return {y: np.linalg.solve(t[y][: p * p].reshape(p, p) + np.diag([1e-9] + [1e-3] * (p - 1)), t[y][p * p :]) for y in TARGETS}

    beta = solve()
    for _ in range(ROUNDS):
        em = total(lambda row, y: b.effects(beta[y])[2] if (b := block(row, y, var)) else None, 4)  # noqa: B023
        var = {y: (var[y][0], *(max(em[y][i] / em[y][i + 1], 1e-9) if em[y][i + 1] else 1e-9 for i in (0, 2))) for y in TARGETS}
        beta = solve()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("site", "cls", "release", *TARGETS)}
            for site, cells_ in zip(b.column("site").to_pylist(), b.column("cells").to_pylist()):
                row = arrays(cells_)
                for y in TARGETS:
                    own = block(row, y, var)
                    u, v, _ = own.effects(beta[y]) if own else (0.0, {}, None)
                    out[y] += [float(beta[y][0] + beta[y][1 + c] + beta[y][1 + len(classes) + r] + u + v.get(int(c), 0.0)) for c, r in zip(row[0], row[1])]
                for k in ("cls", "release"):
                    out[k] += [c[k] for c in cells_]
                out["site"] += [site] * len(cells_)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.string()) for k in ("site", "cls", "release")] + [pa.array(out[y], pa.float64()) for y in TARGETS], names=["site", "cls", "release", *(f"p_{y}" for y in TARGETS)])

    pred = sites.mapInArrow(predict, "site string, cls string, release string, " + ", ".join(f"p_{y} double" for y in TARGETS))
    return pred, {y: int(m[y][0]) for y in TARGETS}


def fill_buildings(buildings: DataFrame) -> DataFrame:
    """id, release, site, class, height, num_floors, each filled, with is_height_filled, is_num_floors_filled, is_class_filled.

    buildings: id, site, release, height, num_floors, class, geom, updated_at, ingested_at; others are ignored. One row per
    (id, release); rows whose id is NULL are taken as one building per release. A value out of its bounds counts as missing.
    A field without any known value stays NULL with a False mask. Empty tables give an empty result.
    """
    ship(buildings.sparkSession)
    rows = fill_class(materialize(clean(buildings), "clean"))
    rows = rows.withColumns({"cls": F.coalesce("class_filled", F.lit(UNKNOWN)), "site": F.coalesce("site", F.lit(UNKNOWN)), "no_site": F.col("site").isNull(), "release": F.coalesce("release", F.lit(UNKNOWN)), "no_release": F.col("release").isNull(), "lh": F.log("height"), "lf": F.log("num_floors")})
    rows = materialize(rows.withColumn("lr", F.col("lh") - F.col("lf")), "classed")
    pred, known = cell_effects(rows)
    rows = rows.join(pred, ["site", "cls", "release"], "left")

    # The building's own effect, from its rows with a known value at any time: aggregated by id, joined back.
    own = [F.count("dh").alias("nh"), F.sum("dh").alias("sh"), F.sum(F.col("dh") ** 2).alias("qh"), F.count("df").alias("nf"), F.sum("df").alias("sf"), F.sum(F.col("df") ** 2).alias("qf")]
    by_id = materialize(rows.where(F.col("id").isNotNull()).select("id", (F.col("lh") - F.col("p_lh")).alias("dh"), (F.col("lf") - F.col("p_lf")).alias("df")).groupBy("id").agg(*own).where("nh + nf > 0"), "own")

    def ratio(k: str) -> float:
        """Variance within buildings over variance between them."""
        v = by_id.agg(F.sum(F.when(F.col(f"n{k}") > 1, F.col(f"q{k}") - F.col(f"s{k}") ** 2 / F.col(f"n{k}"))).alias("w"), F.sum(F.when(F.col(f"n{k}") > 1, F.col(f"n{k}") - 1)).alias("d"), F.sum(f"q{k}").alias("q"), F.sum(f"n{k}").alias("n")).first()
        if not v["d"] or not v["n"]:
            return 1.0
        within, all_ = max(v["w"], 0.0) / v["d"], v["q"] / v["n"]
        return within / max(all_ - within, 1e-9)

    kh, kf = ratio("h"), ratio("f")
    rows = rows.join(by_id.select("id", "nh", "sh", "nf", "sf"), "id", "left")
    blup = lambda n, s, k: F.when(F.col(n) > 0, F.col(s) / (F.col(n) + F.lit(k)))
    lh_time, lf_time = F.col("p_lh") + blup("nh", "sh", kh), F.col("p_lf") + blup("nf", "sf", kf)
    lf_best = F.coalesce(F.col("lf"), lf_time)
    lh_best = F.coalesce(F.col("lh"), lh_time)
    can_ratio = F.lit(known["lr"] > 0)
    lh = F.coalesce(F.col("lh"), lh_time, F.when(can_ratio, lf_best + F.col("p_lr")), F.when(F.lit(known["lh"] > 0), F.col("p_lh")))
    lf = F.coalesce(F.col("lf"), lf_time, F.when(can_ratio, lh_best - F.col("p_lr")), F.when(F.lit(known["lf"] > 0), F.col("p_lf")))
    fit = lambda v, b: F.when(v.isNotNull(), F.greatest(F.lit(b[0]), F.least(F.lit(b[1]), v)))
    height = F.coalesce(F.col("height"), fit(F.round(F.exp(lh), 1), HEIGHT))
    floors = F.coalesce(F.col("num_floors"), fit(F.round(F.exp(lf)), FLOORS))
    return rows.select(
        "id", F.when(~F.col("no_release"), F.col("release")).alias("release"), F.when(~F.col("no_site"), F.col("site")).alias("site"), F.col("class_filled").alias("class"),
        height.alias("height"), floors.alias("num_floors"),
        (F.col("height").isNull() & height.isNotNull()).alias("is_height_filled"), (F.col("num_floors").isNull() & floors.isNotNull()).alias("is_num_floors_filled"), "is_class_filled",
    )


def filled_cases(filled: DataFrame) -> DataFrame:
    """(id, release, field): one row for each value of height and num_floors that was filled."""
    fields = F.array_compact(F.array(F.when(F.col("is_height_filled"), F.lit("height")), F.when(F.col("is_num_floors_filled"), F.lit("num_floors"))))
    return filled.select("id", "release", F.explode(fields).alias("field"))
