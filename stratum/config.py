"""Settings: defaults, then a JSON file, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """commit_depth: commits to index, 0 for all. top_k: base number of neighbours. repository: owner/name, if it
    differs from the remote. provider and model: of the language model behind the engine's protocol."""

    commit_depth: int = 1000
    top_k: int = 5
    provider: str = "stub"
    model: str = ""
    endpoint: str = ""
    repository: str = ""

    def with_values(self, values: dict) -> "Config":
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return replace(self, **{k: kinds[k](v) for k, v in values.items() if k in kinds})


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Config:
    out = Config()
    if path and Path(path).exists():
        try:
            out = out.with_values(json.loads(Path(path).read_text()))
        except (ValueError, TypeError):
            pass
    env = os.environ if environment is None else environment
    return out.with_values({k.removeprefix("STRATUM_").lower(): v for k, v in env.items() if k.startswith("STRATUM_")})


def save(path: str, config: Config) -> None:
    Path(path).write_text(json.dumps(asdict(config), indent=2))
