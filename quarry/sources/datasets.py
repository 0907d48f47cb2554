"""Public data sets by name, from files in a folder that all machines share (none is part of this package), and files fetched into it."""

from __future__ import annotations

import hashlib
import os
import shutil
import urllib.request

from pyspark.sql import DataFrame, SparkSession

# Names of data sets and of their target columns.
TARGETS = {
    "iris": "target", "wine": "target", "breast_cancer": "target", "diabetes": "target", "digits": "target", "linnerud": "Weight", "olivetti_faces": "target",
    "california_housing": "MedHouseVal", "covtype": "Cover_Type", "kddcup99": "labels",
}


def data_home(folder: str | None = None) -> str:
    """``folder``, or quarry_data in the user's home; made where it isn't there."""
    path = os.path.expanduser(folder or os.path.join("~", "quarry_data"))
    os.makedirs(path, exist_ok=True)
    return path


def clear_data_home(folder: str) -> None:
    """Deletes a data home; it must be named."""
    shutil.rmtree(os.path.expanduser(folder), ignore_errors=True)


def dataset_dir(name: str, folder: str | None = None) -> str:
    path = os.path.join(data_home(folder), name)
    os.makedirs(path, exist_ok=True)
    return path


def fetch_file(url: str, folder: str | None = None, name: str | None = None, sha256: str | None = None) -> str:
    """The path of the file at ``url`` in the data home; fetched once, moved there whole, refused where its hash differs."""
    path = os.path.join(data_home(folder), name or os.path.basename(url))
    if not os.path.exists(path):
        part = path + ".part"
        with urllib.request.urlopen(url) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(part, path)
    if sha256:
        with open(path, "rb") as f:
            found = hashlib.file_digest(f, "sha256").hexdigest()
        if found != sha256:
            os.remove(path)
            raise ValueError(f"{url}: the hash is {found}")
    return path


def load_dataset(spark: SparkSession, name: str, folder: str, target: str | None = None) -> tuple[DataFrame, list[str], str]:
    """(rows, features, target) of ``folder``/``name``.csv or .parquet; known names bring their target column, else the last column is it."""
    base = f"{folder.rstrip('/')}/{name}"
    try:
        df = spark.read.parquet(base + ".parquet")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.read.csv(base + ".csv", header=True, inferSchema=True)
    y = target or TARGETS.get(name, df.columns[-1])
    return df, [c for c in df.columns if c != y], y
