"""A people-search corpus engine on DataFrames: ingest, resolve, rank, audit."""

from __future__ import annotations

import os
from pathlib import Path


def reach_workers(spark) -> None:
    """Let Python workers started from now on find this package where the driver has
    it.  A cluster on which it is installed does not need it, and it does no harm there."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
