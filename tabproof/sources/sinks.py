"""Writing the tables of a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_run(frames: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> list[str]:
    """Write each table of a run below ``folder`` and return the paths.

    Violating rows are not part of a run: they are the one thing that stays where the
    data is.
    """
    paths = []
    for name, frame in frames.items():
        path = f"{folder.rstrip('/')}/{name}"
        frame.write.mode(mode).format(fmt).save(path)
        paths.append(path)
    return paths
