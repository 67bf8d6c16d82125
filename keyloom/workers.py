"""Python workers that can import this library."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def reachable(query: Callable) -> Callable:
    """query(spark, ...), whose workers look for modules where the driver found this library, whatever its own folder is.

    That serves workers that see the driver's files; on other clusters the library comes with --py-files.
    """

    @wraps(query)
    def run(spark, *args):
        environment = spark.sparkContext.environment
        known = environment.get("PYTHONPATH", "")
        if ROOT not in known.split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
        return query(spark, *args)

    return run
