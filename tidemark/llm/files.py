"""Binary files in the shared work folder, written and read inside tasks."""

import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import SHUFFLES_GO, remove, settings, work_dir


class Scratch:
    """Tables of one job's own, which it deletes when all that was made of them is written too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = work_dir(self.spark, name)
        with settings(self.spark, {SHUFFLES_GO: "true"}):
            df.write.parquet(path)
        table = self.spark.read.parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables."""
        for table, path in self.tables:
            if any(table is t for t in tables):
                remove(self.spark, path)
        self.tables = [(t, path) for t, path in self.tables if not any(t is x for x in tables)]

    def drop_all(self) -> None:
        self.drop(*[t for t, _ in self.tables])


def located(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path on it."""
    if "://" in url or url.startswith("file:"):
        return fs.FileSystem.from_uri(url.replace("s3a://", "s3://"))
    return fs.LocalFileSystem(), url


def new_file(folder: str, suffix: str) -> str:
    """A name no other attempt of a task uses; the rows a task gives name the files that count."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def writer(url: str):
    system, path = located(url)
    return system.open_output_stream(path, compression=None)


def reader(url: str):
    system, path = located(url)
    return system.open_input_file(path)


def mapped(url: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped if the file system is local or mounted."""
    system, path = located(url)
    if isinstance(system, fs.LocalFileSystem):
        empty = system.get_file_info(path).size == 0
        return np.zeros(0, dtype) if empty else np.memmap(path, dtype, "r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)
