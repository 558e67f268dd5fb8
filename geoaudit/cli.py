"""Command line: ``python -m geoaudit.cli unrestricted --dataset lar --out outputs``."""

from __future__ import annotations

import argparse

from .operators.significance import MODES
from .plans.audit import Audit
from .session import session
from .sources.catalog import dataset_names


def fractions(text: str) -> tuple[float, ...]:
    """Comma-separated numbers; blanks are skipped and the list may be empty."""
    try:
        return tuple(float(x) for x in text.split(",") if x.strip())
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"not a list of numbers: {text}") from e


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--out", default="outputs")
    common.add_argument("--data", default="datasets/old", help="folder or URL of the CSV files")
    common.add_argument("--maps", action=argparse.BooleanOptionalAction, default=False)
    common.add_argument("--seed", type=int, default=42)
    common.add_argument("--max-map-points", type=int, default=5000)
    common.add_argument("--quiet", action="store_true")
    common.add_argument("--hdbscan-fracs", type=fractions, default=(0.005, 0.01, 0.02))
    common.add_argument("--mode", choices=MODES, default="binomial", help="how worlds are simulated")
    out = argparse.ArgumentParser(prog="geoaudit")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, dataset: str | None, *numbers: tuple[str, type, object], grid: bool = False) -> None:
        sub = commands.add_parser(name, parents=[common])
        if dataset:
            sub.add_argument("--dataset", choices=dataset_names(), default=dataset)
        for flag, kind, default in numbers:
            sub.add_argument(flag, type=kind, default=default)
        if grid:
            sub.add_argument("--notebook-grid", action="store_true", help="one 20x20 grid")

    level = ("--signif-level", float, 0.005)
    command("unrestricted", "lar", ("--kmeans-seeds", int, 100), ("--n-alt-worlds", int, 200), level)
    command("one-partitioning", "lar", ("--n-alt-worlds", int, 1000), level, grid=True)
    command("multiple-partitionings", "semisynth", ("--n-partitionings", int, 100))
    command("all", None, ("--n-alt-unrestricted", int, 200), ("--n-alt-one", int, 1000), ("--n-partitionings", int, 100), level, grid=True)
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    audit = Audit(session(), a.out, a.maps, a.seed, a.hdbscan_fracs, a.max_map_points, not a.quiet, a.mode, a.data)
    if a.command == "unrestricted":
        audit.unrestricted(a.dataset, a.n_alt_worlds, a.signif_level, a.kmeans_seeds)
    elif a.command == "one-partitioning":
        audit.one_partitioning(a.dataset, a.n_alt_worlds, a.signif_level, a.notebook_grid)
    elif a.command == "multiple-partitionings":
        audit.multiple_partitionings(a.dataset, a.n_partitionings)
    else:
        audit.suite(a.n_alt_unrestricted, a.n_alt_one, a.n_partitionings, a.signif_level, a.notebook_grid)
    for path in audit.write():
        audit.log(f"wrote {path}")


if __name__ == "__main__":
    main()
