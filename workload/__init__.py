"""Registered queries over the driver's tables, with their DuckDB counterparts."""

from importlib import import_module
from pathlib import Path


def load_all() -> None:
    for f in sorted(Path(__file__).parent.glob("q_*.py")):
        import_module(f"workload.{f.stem}")
