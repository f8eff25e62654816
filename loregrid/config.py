"""Settings: defaults, a file of key: value lines with sections, and the environment over both."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .functions import fixed


@dataclass
class Settings:
    root: str = "store"
    vault: str = ""
    projects: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=lambda: [".git", "node_modules", "__pycache__", ".venv", "build", "dist"])
    max_chunk_size: int = fixed.CHUNK_TOKENS
    chunk_overlap: int = fixed.CHUNK_OVERLAP
    embedding_batch: int = 16
    max_files: int = 8
    max_chunks: int = 400
    max_seconds: int = 240

    def to_text(self) -> str:
        """The settings as the file that ``load`` reads."""
        out = []
        for key, value in asdict(self).items():
            if isinstance(value, dict):
                out += [f"{key}:", *(f"  {k}: {v}" for k, v in value.items())]
            elif isinstance(value, list):
                out += [f"{key}:", *(f"  - {v}" for v in value)]
            else:
                out.append(f"{key}: {value}")
        return "\n".join(out) + "\n"


def load(*candidates: str, prefix: str = "LOREGRID_") -> Settings:
    """Settings from the first file that exists, overridden by ``LOREGRID_<KEY>`` variables."""
    settings, section = Settings(), None
    for line in next((Path(p).read_text() for p in candidates if Path(p).is_file()), "").splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] == " " and section is not None:
            item, now = line.strip(), getattr(settings, section, None)
            if isinstance(now, list):
                now.append(item.removeprefix("- ").strip())
            elif isinstance(now, dict):
                key, _, value = item.partition(":")
                now[key.strip()] = value.strip()
            continue
        key, _, value = (x.strip() for x in line.partition(":"))
        if hasattr(settings, key):
            if value:
                setattr(settings, key, type(getattr(settings, key))(value) if not isinstance(getattr(settings, key), list | dict) else getattr(settings, key))
            else:
                section = key
                setattr(settings, key, type(getattr(settings, key))())
    for key, value in os.environ.items():
        name = key.removeprefix(prefix).lower()
        if key.startswith(prefix) and hasattr(settings, name) and not isinstance(getattr(settings, name), list | dict):
            setattr(settings, name, type(getattr(settings, name))(value))
    return settings
