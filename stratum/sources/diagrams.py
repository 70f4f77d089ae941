"""Saved diagrams: a text file each, whose first line tells kind, title and time in JSON."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

SUFFIX, MARK = ".mmd", "%% "


class Diagrams:
    """Diagrams in a folder of the driver. Names are made from titles and never leave the folder."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def _at(self, name: str) -> Path:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"no diagram's name: {name!r}")
        return self.folder / f"{name}{SUFFIX}"

    def save(self, kind: str, title: str, text: str, now: float | None = None) -> str:
        now = time.time() if now is None else now
        name = f"{re.sub(r'[^A-Za-z0-9]+', '-', title).strip('-').lower()[:60] or kind}-{int(now * 1000)}"
        self.folder.mkdir(parents=True, exist_ok=True)
        self._at(name).write_text(f"{MARK}{json.dumps({'kind': kind, 'title': title, 'saved': now})}\n{text}")
        return name

    def _read(self, path: Path) -> tuple[dict, str]:
        head, _, body = path.read_text().partition("\n")
        try:
            return (json.loads(head.removeprefix(MARK)), body) if head.startswith(MARK) else ({}, f"{head}\n{body}")
        except ValueError:
            return {}, body

    def list(self) -> list[dict]:
        """Name and header of each, the latest first."""
        found = [{"kind": "", "title": p.stem, "saved": 0.0} | self._read(p)[0] | {"name": p.stem} for p in self.folder.glob(f"*{SUFFIX}")]
        return sorted(found, key=lambda d: (-d["saved"], d["name"]))

    def load(self, name: str) -> str:
        return self._read(self._at(name))[1]

    def delete(self, name: str) -> bool:
        if there := self._at(name).exists():
            self._at(name).unlink()
        return there
