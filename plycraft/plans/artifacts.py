"""Artifacts of a run: tables, JSON documents, pointers and what binds them together.

A run is a folder with one writer. Tables are Parquet folders that appear by a rename.
Files written by Spark differ from run to run, so a table's fingerprint is of its rows: it
does not depend on their order or on how files are laid out, and is computed by Spark.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterable
from hashlib import sha256
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def clean(value: Any) -> Any:
    """Without NaN and infinities, which become null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def fingerprint(rows: DataFrame) -> str:
    """Order-independent digest of a table's rows, columns by name."""
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"p{i}") for i in range(5)]
    got = rows.select(line.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return sha256(json.dumps([sorted(rows.dtypes), [str(x) for x in got]]).encode()).hexdigest()


class Run:
    """A run's folder (a path that the driver and Spark share)."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, name: str) -> Path:
        return self.folder / name

    def has(self, name: str) -> bool:
        return self.path(name).exists()

    # ------------------------------------------------ tables

    def write_table(self, name: str, rows: DataFrame, schema: StructType | None = None) -> DataFrame:
        """Write beside, then rename: a table is there whole or not at all."""
        if schema is not None:
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        final = self.path(name)
        final.parent.mkdir(parents=True, exist_ok=True)
        staged = final.with_name(f".{final.name}-{uuid.uuid4().hex}")
        rows.write.parquet(str(staged))
        if final.exists():
            os.rename(final, final.with_name(f".old-{final.name}-{uuid.uuid4().hex}"))
        os.rename(staged, final)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.path(name)))

    # ------------------------------------------------ documents

    def write_json(self, name: str, value: Any, *, fixed: bool = False) -> Path:
        """Write a document atomically; numbers that JSON lacks are an error. A ``fixed`` one
        may be written again only with the same content."""
        path = self.path(name)
        if fixed and path.exists():
            if self.json(name) != json.loads(json.dumps(value, allow_nan=False)):
                raise ValueError(f"{name} already exists with different content")
            return path
        path.parent.mkdir(parents=True, exist_ok=True)
        staged = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
        staged.write_text(json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False, allow_nan=False), encoding="utf-8")
        os.replace(staged, path)
        return path

    def write_json_rows(self, name: str, head: dict, key: str, rows: Iterable[str], *, fixed: bool = False) -> Path:
        """A document whose last entry ``key`` is a list, written row by row (each already
        JSON) as they come, so the list never is in memory. ``fixed`` as in ``write_json``."""
        path = self.path(name)
        path.parent.mkdir(parents=True, exist_ok=True)
        staged = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
        with staged.open("w", encoding="utf-8") as out:
            out.write(json.dumps(head, sort_keys=True, ensure_ascii=False, allow_nan=False)[:-1] + f', "{key}": [')
            for n, row in enumerate(rows):
                out.write((",\n" if n else "\n") + row)
            out.write("\n]}")
        if fixed and path.exists() and sha256(path.read_bytes()).digest() != sha256(staged.read_bytes()).digest():
            staged.unlink()
            raise ValueError(f"{name} already exists with different content")
        os.replace(staged, path)
        return path

    def write_text(self, name: str, text: str) -> Path:
        return self.write_bytes(name, text.encode())

    def write_bytes(self, name: str, data: bytes) -> Path:
        path = self.path(name)
        path.parent.mkdir(parents=True, exist_ok=True)
        staged = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
        staged.write_bytes(data)
        os.replace(staged, path)
        return path

    def json(self, name: str) -> Any:
        return json.loads(self.path(name).read_text(encoding="utf-8"))

    # ------------------------------------------------ what binds them

    def digest(self, name: str) -> str:
        """Of a table its rows, of a document its bytes."""
        path = self.path(name)
        return fingerprint(self.table(name)) if path.is_dir() else sha256(path.read_bytes()).hexdigest()

    def digests(self, *names: str) -> dict[str, str]:
        return {n: self.digest(n) for n in names}

    def verify(self, expected: dict[str, str], what: str = "Input") -> None:
        for name, digest in expected.items():
            if not self.has(name) or self.digest(name) != digest:
                raise ValueError(f"{what} changed: {name}")

    def point(self, pointer: str, name: str) -> None:
        self.write_json(pointer, {"path": name, "sha256": self.digest(name)})

    def pointed(self, pointer: str) -> str:
        """The artifact that a pointer names, unchanged since."""
        at = self.json(pointer)
        self.verify({at["path"]: at["sha256"]}, "Active artifact")
        return at["path"]

    def refuse(self, *names: str, why: str) -> None:
        """These stages happen once."""
        for name in names:
            if self.has(name):
                raise ValueError(f"{why}: {name} exists")


def key_of(config: dict) -> str:
    """Short content address of a configuration."""
    return sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
