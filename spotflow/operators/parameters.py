"""Parameters of an analysis as a tree of defaults, as a table of paths, and what differs between two."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

INF = math.inf
#: The defaults of the analysis.
DEFAULTS = {
    "general": {"analysis steps": {"localization": True, "tracking": True, "MSD analysis": True, "cluster analysis": True}, "batch text": "", "raw output": {"localization": False, "tracking": False}},
    "localization": {
        "offset": 100.0, "conversion": 0.48, "pixel size": 100.0, "filter size": 1.3, "cutoff": 3.0, "ROI": 7,
        "limits": {k: {"lower": 0.0, "upper": INF} for k in ("PSF", "photons", "precision")},
    },
    "tracking": {
        "max link distance": 150.0, "max gap close": 4,
        "limits": {"N": {"lower": 3.0, "upper": INF}, **{k: {"lower": 0.0, "upper": INF} for k in ("duration", "displacement", "range")}},
    },
    "MSD analysis": {"frame rate": 50.0, "min track length": 8, "adj R2": 0.4, "fit points": [2, 4], "split value": -1.75},
    "cluster": {
        "algorithm": "Voronoi", "input": "track centroids", "min N": 5, "DBSCAN": {"min pts": 4, "epsilon": 280.0}, "NASTIC": {"r": 1.0}, "segNASTIC": {"r": 1.0, "overlaps": 2},
        "Voronoi": {"method": "density", "alpha": 2.0, "area threshold": 20.0, "trim edges": True, "trim boundary": "AABB", "trim method": "intersect"},
    },
}


def flatten(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value) of every leaf; the words of a path are joined by spaces."""
    out = []
    for name, value in tree.items():
        path = f"{prefix} {name}".strip()
        out += flatten(value, path) if isinstance(value, dict) else [(path, str(value))]
    return out


def parameter_table(spark: SparkSession, tree: dict = DEFAULTS) -> DataFrame:
    return spark.createDataFrame(flatten(tree), "path string, value string")


def parameters_of(files: DataFrame, tree: dict = DEFAULTS) -> DataFrame:
    """The parameters of the tree (path, value) for every row of files, with its columns."""
    leaves = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in flatten(tree)])
    return files.select("*", F.explode(leaves).alias("_leaf")).select(*files.columns, "_leaf.path", "_leaf.value")


def changed(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The columns `by`, path, old_value and new_value of parameters whose values differ or that only one side has."""
    both = old.select(*by, "path", F.col("value").alias("old_value")).join(new.select(*by, "path", F.col("value").alias("new_value")), [*by, "path"], "full")
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
