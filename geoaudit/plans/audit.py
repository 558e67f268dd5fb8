"""The experiments: free scan, fixed grids, many grids, each beside density-based clusters."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions as R
from ..operators import significance as S
from ..operators.hdbscan import Clustering, clusterings
from ..operators.scan import best_region, scored, variance_summary
from ..sources.catalog import DATASETS, Dataset, dataset
from ..sources.maps import cluster_shapes, save_map
from ..sources.points import Profile, load_dataset, profile
from .report import best_values, result_row, rows_frame, write_by_dataset

MOST_BOXES = 28
FILES = {
    "unrestricted": "unrestricted_{dataset}_regions.csv",
    "one_partitioning": "one_partitioning_{dataset}.csv",
    "multiple_partitionings": "multiple_partitionings_{dataset}.csv",
    "hdbscan": "hdbscan_{dataset}_comparison.csv",
}


@dataclass
class Loaded:
    """Cached points of a dataset, their totals, and clusterings made so far."""

    spec: Dataset
    points: DataFrame
    profile: Profile
    clusterings: dict[tuple[float, ...], list[Clustering]] = field(default_factory=dict)


def _scan_row(scores: DataFrame) -> tuple[object, float, int]:
    best = best_region(scores).first()
    return best, best["sul"] if best else 0.0, scores.count()


@dataclass
class Audit:
    """Runs experiments and gathers their rows. ``mode`` chooses how worlds are simulated."""

    spark: SparkSession
    out: str | Path = "outputs"
    maps: bool = False
    seed: int = 42
    fractions: tuple[float, ...] = (0.005, 0.01, 0.02)
    max_map_points: int = 5000
    verbose: bool = True
    mode: str = "binomial"
    root: str = "datasets/old"

    def __post_init__(self):
        self.out = Path(self.out)
        self.out.mkdir(parents=True, exist_ok=True)
        self.rows: dict[str, list[dict]] = {k: [] for k in FILES}
        self._loaded: dict[str, Loaded] = {}
        self._start = time.monotonic()

    def log(self, text: str) -> None:
        self.spark.sparkContext.setJobDescription(text)
        if self.verbose:
            print(f"[{time.monotonic() - self._start:8.1f}s] {text}", flush=True)

    def add(self, spec: Dataset, points: DataFrame) -> Loaded:
        """Take points from any source as a dataset."""
        points = points.persist()
        self._loaded[spec.name] = Loaded(spec, points, profile(points))
        return self._loaded[spec.name]

    def load(self, name: str) -> Loaded:
        if name not in self._loaded:
            spec = dataset(name)
            self.log(f"load {name}")
            self.add(spec, load_dataset(self.spark, spec, self.root).select("point_id", "lon", "lat", "outcome"))
        return self._loaded[name]

    def clusters(self, data: Loaded) -> list[Clustering]:
        if self.fractions not in data.clusterings:
            self.log(f"{data.spec.name}: HDBSCAN {self.fractions}")
            data.clusterings[self.fractions] = clusterings(data.points, self.fractions)
        return data.clusterings[self.fractions]

    def evaluate_clusters(self, experiment: str, data: Loaded, worlds: int, level: float) -> list[tuple[dict, Clustering, DataFrame | None]]:
        """Score each clustering; significance only with worlds and clusters, else its threshold is missing."""
        found, p = [], data.profile
        for c in self.clusters(data):
            members = c.regions().join(data.points, "point_id").select("point_id", "outcome", F.col("cluster_label").cast("long").alias("region_id")).persist()
            stats = R.counted(members, "region_id")
            scores = scored(stats, p.n, p.p).persist()
            best, top, n = _scan_row(scores)
            variance = variance_summary(stats).first()
            ranked = limit = None
            if worlds > 0 and n:
                points = members.withColumn("region_ids", F.array("region_id"))
                maxima = S.world_maxima(points, stats, p.n, p.p, worlds, self.seed + c.min_size, self.mode)
                limit_frame = S.threshold(maxima, worlds, level)
                limit = limit_frame.first()["threshold"]
                ranked = S.significant(scores, self.spark.createDataFrame([(limit,)], "threshold double"))
            row = result_row(
                experiment, data.spec.name, "hdbscan", {"min_cluster_frac": c.fraction, "min_cluster_size": c.min_size, "metric": "haversine"}, p, best,
                n_regions=n, max_sul=top, signif_threshold=limit, significant_regions=ranked.count() if ranked is not None else 0,
                meanvar=variance["meanvar"] if variance else 0.0, meanvar_max_score=variance["max_score"] if variance else 0.0, noise_n=c.noise().count(),
            )
            self.rows["hdbscan"].append(row)
            found.append((row, c, ranked))
        return found

    def _cluster_layer(self, data: Loaded, evaluated) -> list[dict]:
        """Shapes of the significant clusters of the clustering with the largest score, the first of equals."""
        best = max(evaluated, key=lambda x: x[0]["max_sul"] or 0.0, default=None)
        if best is None or best[2] is None:
            return []
        chosen = best[2].select(F.col("region_id").cast("int").alias("cluster_label"))
        return cluster_shapes(data.points, best[1].regions().join(chosen, "cluster_label"))

    def _map(self, data: Loaded, name: str, **shown) -> None:
        self.log(f"map {name}")
        save_map(data.points, self.out / f"{name}.html", data.profile, name, most=self.max_map_points, seed=self.seed, **shown)

    def unrestricted(self, name: str = "lar", worlds: int = 200, level: float = 0.005, n_seeds: int = 100) -> list[dict]:
        """Squares of all radii around KMeans seeds: scan, threshold, ranking, pruning; then clusters."""
        data = self.load(name)
        p, radii = data.profile, data.spec.radius_values()
        self.log(f"{name}: unrestricted scan")
        seeds = R.kmeans_seeds(data.points, n_seeds, self.seed)
        stats = R.square_stats(data.points, seeds, radii).persist()
        scores = scored(stats, p.n, p.p).persist()
        best, top, n = _scan_row(scores)
        maxima = S.world_maxima(R.with_square_ids(data.points, seeds, radii, True), stats, p.n, p.p, worlds, self.seed, self.mode, len(radii))
        limit = S.threshold(maxima, worlds, level).first()["threshold"] if n else 0.0
        ranked = S.significant(scores, self.spark.createDataFrame([(limit,)], "threshold double")).persist()
        kept = S.pruned(ranked).persist()
        self.rows["unrestricted"].append(result_row(
            "unrestricted", name, "kmeans_scan", {"n_seeds": n_seeds, "radii": radii}, p, best,
            n_regions=n, max_sul=top, signif_threshold=limit, significant_regions=ranked.count(), non_overlapping_regions=kept.count(),
        ))
        evaluated = self.evaluate_clusters("unrestricted", data, worlds, level)
        if self.maps:
            boxes = [r.asDict() for r in kept.where(F.col("kept_rank") <= MOST_BOXES).orderBy("kept_rank").collect()]
            self._map(data, f"unrestricted_{name}", boxes=boxes, clusters=self._cluster_layer(data, evaluated))
        return self.rows["unrestricted"]

    def one_partitioning(self, name: str = "lar", worlds: int = 1000, level: float = 0.005, single_grid: bool = False) -> list[dict]:
        """Every cell of the dataset's grids by both scores, with significance; then clusters."""
        data = self.load(name)
        p = data.profile
        for lon_n, lat_n in ((20, 20),) if single_grid else data.spec.grids:
            self.log(f"{name}: grid {lon_n}x{lat_n}")
            stats = R.grid_of(data.points, lon_n, lat_n, p).persist()
            scores = scored(stats, p.n, p.p).persist()
            best, top, n = _scan_row(scores)
            variance = variance_summary(stats).first()
            maxima = S.world_maxima(R.with_cells(data.points, p, lon_n, lat_n), stats, p.n, p.p, worlds, self.seed + lon_n + lat_n, self.mode)
            limit = S.threshold(maxima, worlds, level).first()["threshold"] if n else 0.0
            ranked = S.significant(scores, self.spark.createDataFrame([(limit,)], "threshold double")).persist()
            row = result_row(
                "one_partitioning", name, "grid", {"lon_n": lon_n, "lat_n": lat_n}, p, best,
                n_regions=n, max_sul=top, signif_threshold=limit, significant_regions=ranked.count(),
                meanvar=variance["meanvar"] if variance else 0.0, meanvar_max_score=variance["max_score"] if variance else 0.0,
            )
            row |= best_values("meanvar_best", {"n": variance["best_n"], "p": variance["best_p"]} if variance else None)
            self.rows["one_partitioning"].append(row)
            if self.maps:
                self._map(data, f"one_partitioning_{name}_{lon_n}x{lat_n}", grid=[r.asDict() for r in ranked.orderBy("rank").collect()])
        evaluated = self.evaluate_clusters("one_partitioning", data, worlds, level)
        if self.maps:
            self._map(data, f"one_partitioning_{name}_hdbscan", clusters=self._cluster_layer(data, evaluated))
        return self.rows["one_partitioning"]

    def multiple_partitionings(self, name: str = "semisynth", n_grids: int = 100) -> list[dict]:
        """The variance of rates over random grids, all in one plan, with a summary row; then clusters."""
        data = self.load(name)
        p = data.profile
        self.log(f"{name}: {n_grids} random grids")
        sizes = R.random_grids(n_grids, seed=self.seed)
        summary = variance_summary(R.grid_stats(data.points, R.grid_table(self.spark, sizes), sizes, p), "grid_idx") if sizes else None
        detail = {r["grid_idx"]: r for r in summary.collect()} if summary is not None else {}
        rows = self.rows["multiple_partitionings"]
        for k, lon_n, lat_n in sizes:
            v = detail.get(k)
            rows.append(result_row(
                "multiple_partitionings", name, "random_grid", {"partitioning_idx": k, "lon_n": lon_n, "lat_n": lat_n}, p,
                {"n": v["best_n"], "p": v["best_p"]} if v else None, n_regions=v["n_regions"] if v else 0,
                meanvar=v["meanvar"] if v else 0.0, meanvar_max_score=v["max_score"] if v else 0.0,
            ))
        means = [v["mean_score"] for v in detail.values()]
        rows.append(result_row(
            "multiple_partitionings", name, "random_grid_summary", {"n_partitionings": n_grids, "lat_n_range": [10, 40], "lon_n_range": [10, 40]}, p,
            n_regions=sum(v["n_regions"] for v in detail.values()), meanvar=sum(means) / len(means) if means else 0.0,
            meanvar_max_score=max((v["max_score"] for v in detail.values()), default=0.0),
        ))
        self.evaluate_clusters("multiple_partitionings", data, 0, 0.0)
        return rows

    def suite(self, worlds_free: int = 200, worlds_grid: int = 1000, n_grids: int = 100, level: float = 0.005, single_grid: bool = False) -> None:
        """All experiments on the datasets of the published suite."""
        self.unrestricted("lar", worlds_free, level)
        for name in ("lar", "crime"):
            self.one_partitioning(name, worlds_grid, level, single_grid)
        for name in ("semisynth", "synth_unfair"):
            self.multiple_partitionings(name, n_grids)

    def frame(self, kind: str) -> DataFrame:
        """Rows of one kind as a DataFrame."""
        return rows_frame(self.spark, self.rows[kind])

    def write(self) -> list[Path]:
        return [path for kind, template in FILES.items() for path in write_by_dataset(self.rows[kind], self.out, template)]


__all__ = ["Audit", "DATASETS", "FILES", "Loaded"]
