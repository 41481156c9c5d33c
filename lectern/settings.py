"""Settings: defaults, overlaid by a JSON file."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path


@dataclasses.dataclass
class Settings:
    voice: str = "af_heart"
    speed: float = 0.9
    max_chars: int = 400
    sentence_pause: float = 0.4
    clause_pause: float = 0.18
    max_concurrent_jobs: int = 1
    keep_intermediates: bool = False

    def __post_init__(self) -> None:
        self.max_concurrent_jobs = max(1, self.max_concurrent_jobs)


def load(path: str | Path) -> Settings:
    """The settings of a file; one that is missing or broken changes nothing, unknown names are ignored."""
    try:
        given = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        given = {}
    known = {f.name for f in dataclasses.fields(Settings)}
    return Settings(**{k: v for k, v in given.items() if k in known}) if isinstance(given, dict) else Settings()


def save(settings: Settings, path: str | Path) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(settings)))
