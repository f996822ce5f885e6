"""Driver-side control: configuration, frozen experiments, locks and stage gates."""

from __future__ import annotations

import contextlib
import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ..session import create_new_file, delete_folder, file_exists, read_text, write_text


@dataclass(frozen=True)
class Settings:
    method: str = "topk"
    neighbours: int = 16
    temperature: float = 0.07
    family_cap: int = 2
    boundary_weight: float = 0.5
    foreground_minimum: float = 0.5
    top_fraction: float = 0.1
    threshold_quantile: float = 0.99
    frames: int = 32
    seed: int = 42
    match_count: int = 8
    #: Settings that only say how to run, and so may change within an experiment.
    runtime: tuple[str, ...] = ("shuffle_partitions", "broadcast_bytes")
    shuffle_partitions: int = 200
    broadcast_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        if self.method not in ("nearest", "topk"):
            raise ValueError("method is nearest or topk")
        for name in ("neighbours", "family_cap", "frames", "match_count", "shuffle_partitions"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("foreground_minimum", "top_fraction", "threshold_quantile", "boundary_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be within 0 and 1")
        if self.temperature <= 0 or self.top_fraction == 0:
            raise ValueError("temperature and top_fraction must be above 0")

    def spec(self) -> dict:
        """What identifies an experiment."""
        return {k: v for k, v in dataclasses.asdict(self).items() if k not in (*self.runtime, "runtime")}


def load_settings(path: str | None, overrides: dict) -> Settings:
    """Overrides before the file before the defaults; unknown names are an error."""
    known = {f.name for f in dataclasses.fields(Settings)} - {"runtime"}
    values = json.loads(Path(path).read_text()) if path else {}
    values |= {k: v for k, v in overrides.items() if v is not None}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**values)


def freeze(spark: SparkSession, settings: Settings, folder: str) -> None:
    """Writes the experiment's spec to a folder in any store, or demands that the one written before is the same."""
    path = f"{folder}/settings.json"
    text = json.dumps(settings.spec(), sort_keys=True, indent=1, allow_nan=False)
    if not file_exists(spark, path):
        write_text(spark, path, text)
    elif json.loads(read_text(spark, path)) != json.loads(text):
        raise ValueError(f"{path} belongs to another experiment")


def recover(backup: str, folder: str) -> bool:
    """Restores a lost spec from a backup, byte for byte; whether there was something to restore."""
    source, target = Path(backup) / "settings.json", Path(folder) / "settings.json"
    if target.exists() or not source.exists():
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(source.read_bytes())
    return True


@contextlib.contextmanager
def run_lock(spark: SparkSession, folder: str) -> Iterator[None]:
    """Only one run at a time works in a folder of any store: the lock is a file that only one can create. A run that was killed leaves
    it, and says so by its name."""
    path = f"{folder}/run.lock"
    if not create_new_file(spark, path):
        raise RuntimeError(f"{folder} is in use; if no run works there, delete {path}")
    try:
        yield
    finally:
        delete_folder(spark, path)


def require_stage(spark: SparkSession, folder: str, stage: str) -> None:
    if not file_exists(spark, f"{folder}/{stage}/_SUCCESS"):
        raise RuntimeError(f"{stage} has not been completed in {folder}")
