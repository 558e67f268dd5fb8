"""Named datasets: where their points are, how outcomes are labelled, and how regions are laid over them."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np


@dataclass(frozen=True)
class Dataset:
    """A CSV file of points, its label column, and the parameters of its scans.

    ``radii`` is start, stop (not included) and step in degrees; ``grids`` are (columns, rows);
    ``recode`` maps label values before they are cut to whole numbers.
    """

    name: str
    file: str
    label: str
    radii: tuple[float, float, float]
    grids: tuple[tuple[int, int], ...] = ((20, 20),)
    recode: tuple[tuple[int, int], ...] = ()

    def radius_values(self) -> list[float]:
        return radius_values(*self.radii)


def radius_values(start: float, stop: float, step: float) -> list[float]:
    return [float(x) for x in np.round(np.arange(start, stop, step), 10)]


# Files, labels, radii and grids of the published experiments.
DATASETS = {
    d.name: d
    for d in (
        Dataset("lar", "LAR.csv", "action_taken", (0.05, 1.01, 0.05), ((100, 50), (25, 12)), ((3, 0),)),
        Dataset("crime", "Crime.csv", "pred", (0.005, 0.1, 0.005)),
        Dataset("semisynth", "Semisynth.csv", "label", (0.01, 0.2, 0.01)),
        Dataset("synth_fair", "Synth_fair.csv", "label", (0.01, 0.2, 0.01)),
        Dataset("synth_unfair", "Synth_unfair.csv", "label", (0.01, 0.2, 0.01)),
    )
}


def dataset_names() -> tuple[str, ...]:
    return tuple(DATASETS)


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"Unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name]


def dataset_path(spec: Dataset, root: str | Path = "datasets/old") -> str:
    """The file of a dataset. A local root is looked into; a URL is left to Spark."""
    path = f"{str(root).rstrip('/')}/{spec.file}"
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"No file for dataset {spec.name!r}: {path}")
    return path
