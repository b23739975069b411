"""Settings of a document pipeline, kept as JSON on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass
class PipelineConfig:
    """How documents are cleaned, de-duplicated, embedded and stored."""

    embedder: str = "hash"
    dimension: int = 64
    batch_rows: int = 64
    max_records: int = 10_000_000
    output: str = ""
    shingle: int = 1
    reset_every: int = 50_000
    strip_markup: bool = True
    compose_characters: bool = True
    remove_addresses: bool = True
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> PipelineConfig:
        """Settings by name; names that are none are passed over."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @classmethod
    def from_json(cls, path: str) -> PipelineConfig:
        """FileNotFoundError where there is no such file."""
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def save_json(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2, ensure_ascii=False)
