"""One TOML file; relative folders count from it, three environment variables override it."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Config:
    data_dir: Path = Path("data")
    source: str = ""
    flush_rows: int = 100_000
    search_commit_transactions: int = 64
    log_budget_bytes: int = 8 << 30
    warn_share: float = 0.5
    shed_share: float = 0.7
    default_class: str = "eventual"
    history_days: int = 7

    def ingest(self, spark, tables):
        """Tables under the data folder that follow a log, flushed as configured."""
        from tidemark.streaming.ingest import Ingest

        return Ingest(spark, str(self.data_dir), tables, flush_rows=self.flush_rows)

    def rung(self, retained: int) -> int:
        """How far a log of this size has used up its budget."""
        from tidemark.plans.engine import budget_rung

        return budget_rung(retained, self.log_budget_bytes, self.warn_share, self.shed_share)


def load(path: str | Path) -> Config:
    raw = tomllib.loads(Path(path).read_text())
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__}
    for name, key, kind in (("TIDEMARK_DATA_DIR", "data_dir", str), ("TIDEMARK_SOURCE", "source", str), ("TIDEMARK_LOG_BUDGET", "log_budget_bytes", int)):
        if name in os.environ:
            known[key] = kind(os.environ[name])
    if "data_dir" in known:
        folder = Path(known["data_dir"])
        known["data_dir"] = folder if folder.is_absolute() else Path(path).resolve().parent / folder
    return Config(**known)
