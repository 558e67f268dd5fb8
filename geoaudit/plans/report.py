"""Result rows and their CSV files."""

from __future__ import annotations

import csv
import json
import math
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.points import Profile

# The columns of a result row, in order.
COLUMNS = {
    "experiment": "string", "dataset": "string", "method": "string", "params": "string", "N": "long", "P": "long", "global_rate": "double",
    "n_regions": "long", "max_sul": "double", "signif_threshold": "double", "significant_regions": "long", "non_overlapping_regions": "long",
    "meanvar": "double", "meanvar_max_score": "double", "noise_n": "long", "noise_rate": "double",
    "best_region_n": "long", "best_region_p": "long", "best_region_rate": "double",
    "meanvar_best_n": "long", "meanvar_best_p": "long", "meanvar_best_rate": "double",
}


def params_json(values: dict) -> str:
    """Keys in order, a space after commas and colons."""
    return json.dumps(values, sort_keys=True)


def result_row(experiment: str, dataset: str, method: str, params: dict, p: Profile, best=None, **values) -> dict:
    """One row. ``best`` has n, p and rho of the best region; without one they are 0, 0 and missing."""
    row = dict.fromkeys(COLUMNS)
    row |= {"experiment": experiment, "dataset": dataset, "method": method, "params": params_json(params), "N": p.n, "P": p.p, "global_rate": p.rate}
    row |= best_values("best_region", best)
    row |= values
    if row["noise_n"] is not None and p.n:
        row["noise_rate"] = row["noise_n"] / p.n
    return row


def best_values(prefix: str, best) -> dict:
    n, q = (int(best["n"]), int(best["p"])) if best is not None else (0, 0)
    return {f"{prefix}_n": n, f"{prefix}_p": q, f"{prefix}_rate": q / n if n else None}


def rows_frame(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    kind = ", ".join(f"`{c}` {t}" for c, t in COLUMNS.items())
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], kind)


def _cell(value) -> object:
    return "" if value is None or isinstance(value, float) and math.isnan(value) else value


def write_csv(rows: list[dict], path: Path) -> Path | None:
    """A file with a header, quotes doubled, missing values empty; nothing for no rows. Columns as they come."""
    if not rows:
        return None
    path.parent.mkdir(parents=True, exist_ok=True)
    columns = list(dict.fromkeys(c for r in rows for c in r))
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(columns)
        out.writerows([_cell(r.get(c)) for c in columns] for r in rows)
    return path


def write_by_dataset(rows: list[dict], folder: Path, template: str) -> list[Path]:
    """A file for each dataset among the rows, by name; rows without the column go to one for ``all``."""
    if not any("dataset" in r for r in rows):
        return [p for p in [write_csv(rows, folder / template.format(dataset="all"))] if p]
    names = sorted({r.get("dataset") for r in rows}, key=lambda x: (x is None, str(x)))
    return [write_csv([r for r in rows if r.get("dataset") == name], folder / template.format(dataset=name)) for name in names]


def write_frame_by_dataset(frame: DataFrame, folder: str, template: str) -> list[str]:
    """The same for a result table of any size: one folder of CSV files for each dataset, written by Spark."""
    paths = []
    for row in frame.select("dataset").distinct().orderBy("dataset").toLocalIterator():
        path = f"{folder}/{template.format(dataset=row['dataset'])}"
        frame.where(frame["dataset"].eqNullSafe(row["dataset"])).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        paths.append(path)
    return paths
