"""Tables as immutable parquet snapshots under one manifest that is replaced atomically."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quern.schemas import schema


class Locked(RuntimeError):
    """Another writer holds the store."""


class SnapshotStore:
    """Versions of tables in a shared folder; readers follow the manifest, one writer flips it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @property
    def manifest(self) -> dict:
        path = self.root / "_manifest.json"
        return json.loads(path.read_text()) if path.exists() else {"tables": {}, "meta": {}}

    def _flip(self, manifest: dict) -> None:
        new = self.root / f"_manifest.{uuid.uuid4().hex}"
        new.write_text(json.dumps(manifest, indent=1, sort_keys=True))
        os.replace(new, self.root / "_manifest.json")

    def read(self, table: str) -> DataFrame:
        """The current snapshot; an empty table where there is none."""
        version = self.manifest["tables"].get(table)
        if version is None:
            return self.spark.createDataFrame([], schema(table))
        return self.spark.read.parquet(str(self.root / table / version))

    def commit(self, meta: dict[str, str | None] | None = None, **tables: DataFrame) -> None:
        """Write new snapshots of ``tables``, then show all of them and ``meta`` at once."""
        manifest = self.manifest
        for table, df in tables.items():
            version = f"v={uuid.uuid4().hex}"
            df.write.parquet(str(self.root / table / version))
            manifest["tables"][table] = version
        for key, value in (meta or {}).items():
            if value is None:
                manifest["meta"].pop(key, None)
            else:
                manifest["meta"][key] = value
        self._flip(manifest)

    def compact(self, file_bytes: int = 128 << 20) -> tuple[int, int]:
        """Rewrite every table into files of about ``file_bytes`` and drop old snapshots; bytes before and after."""
        before = self.size()
        files = {t: max(1, -(-self.size(self.root / t / v) // file_bytes)) for t, v in self.manifest["tables"].items()}
        self.commit(**{t: self.read(t).coalesce(n) for t, n in files.items()})
        current = self.manifest["tables"]
        for table, version in current.items():
            for old in (self.root / table).iterdir():
                if old.name != version:
                    for part in sorted(old.rglob("*"), reverse=True):
                        part.unlink() if part.is_file() else part.rmdir()
                    old.rmdir()
        return before, self.size()

    def size(self, folder: Path | None = None) -> int:
        return sum(p.stat().st_size for p in (folder or self.root).rglob("*") if p.is_file())

    def vectors_state(self) -> str:
        """``none``, ``migrating`` or ``ready``: whether semantic reads can be answered."""
        meta = self.manifest["meta"]
        if meta.get("vector_migration"):
            return "migrating"
        return "ready" if meta.get("vector_generation") else "none"

    def __enter__(self) -> SnapshotStore:
        try:
            os.close(os.open(self.root / "_LOCK", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise Locked(f"{self.root} is locked by another writer") from None
        return self

    def __exit__(self, *_: object) -> None:
        (self.root / "_LOCK").unlink(missing_ok=True)
