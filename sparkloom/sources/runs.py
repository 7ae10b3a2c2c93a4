"""What a run needs around it: where things lie, settings from the environment, a log of its own, and clients by name."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from sparkloom.sources.clients import EmbeddingClient, ExtractionClient, HashEmbeddings, WordExtraction

LOG = logging.getLogger("sparkloom.run")
KEPT_LOGS = 3


@dataclass(frozen=True)
class Layout:
    """Places of a project below its root (K20); the root may be any path that Spark can write to."""

    root: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "root", self.root.rstrip("/"))

    def __getattr__(self, name: str) -> str:
        places = {
            "documents": "documents", "scopes": "config/scopes.json", "glossary": "config/glossary.json", "store": "data/store", "transcriptions": "data/transcriptions",
            "conversions": "data/conversions", "slides": "data/slides", "extractions": "data/extractions", "dropped_edges": "data/dropped_edges", "registry": "data/types.json",
            "audit": "data/promotions.json", "pages": "data/pages", "logs": "logs",
        }
        if name not in places:
            raise AttributeError(name)
        return f"{self.root}/{places[name]}"


def log_path(folder: Path, now: datetime, prefix: str = "run") -> Path:
    """A file named by the time, with a number behind it where the name is taken."""
    stem = f"{prefix}-{now:%Y%m%d-%H%M%S}"
    path, n = folder / f"{stem}.log", 0
    while path.exists():
        n += 1
        path = folder / f"{stem}-{n:03d}.log"
    return path


def prune_logs(folder: Path, keep: int = KEPT_LOGS, prefix: str = "run") -> list[Path]:
    """Deletes all but the newest logs, by time and then name; returns what went."""
    found = sorted(folder.glob(f"{prefix}-*.log"), key=lambda p: (p.stat().st_mtime_ns, p.name))
    old = found[: max(0, len(found) - keep)]
    for path in old:
        path.unlink()
    return old


def start_log(folder: str | Path, keep: int = KEPT_LOGS, now: datetime | None = None) -> Path:
    """Sends the run's messages to a new file, in full, and to the console from INFO on; older files beyond ``keep`` go."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    path = log_path(place, now or datetime.now())
    for handler in list(LOG.handlers):
        LOG.removeHandler(handler)
        handler.close()
    LOG.setLevel(logging.DEBUG)
    LOG.propagate = False
    for handler, level, form in ((logging.FileHandler(path, encoding="utf-8"), logging.DEBUG, "%(asctime)s %(levelname)s %(message)s"), (logging.StreamHandler(sys.stderr), logging.INFO, "%(message)s")):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter(form, datefmt="%Y-%m-%d %H:%M:%S"))
        LOG.addHandler(handler)
    prune_logs(place, keep)
    return path


@dataclass(frozen=True)
class Settings:
    """Which clients to make and how to call them (X11)."""

    extraction: str
    embedding: str
    embedding_batch: int = 4

    @classmethod
    def of(cls, env: Mapping[str, str], prefix: str = "SPARKLOOM_") -> "Settings":
        """From environment variables; what is missing or no number is named in one error."""
        wrong = [f"{prefix}{k} is not set" for k in ("EXTRACTION", "EMBEDDING") if not env.get(f"{prefix}{k}", "").strip()]
        batch = env.get(f"{prefix}EMBEDDING_BATCH", "4").strip()
        if not batch.isdigit() or int(batch) < 1:
            wrong.append(f"{prefix}EMBEDDING_BATCH must be a positive number")
        if wrong:
            raise ValueError("; ".join(wrong))
        return cls(env[f"{prefix}EXTRACTION"].strip(), env[f"{prefix}EMBEDDING"].strip(), int(batch))


#: Makers of clients by name (X17); callers add their own.
EXTRACTION_CLIENTS: dict[str, Callable[[], ExtractionClient]] = {"words": WordExtraction}
EMBEDDING_CLIENTS: dict[str, Callable[[], EmbeddingClient]] = {"hash": HashEmbeddings}


def make_clients(settings: Settings) -> tuple[ExtractionClient, EmbeddingClient]:
    """The clients that settings name; unknown names raise with those that are known."""
    out = []
    for what, name, known in (("extraction", settings.extraction, EXTRACTION_CLIENTS), ("embedding", settings.embedding, EMBEDDING_CLIENTS)):
        if name not in known:
            raise ValueError(f"unknown {what} client {name!r}; known are: {', '.join(sorted(known))}")
        out.append(known[name]())
    return out[0], out[1]
