"""Settings of masking and batching, from a JSON object and overrides."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of the masked-sample and batch queries."""

    max_length: int = 512
    offline_stride: int = 256
    online_stride: int = 128
    mask_rate: float = 0.15
    legal_bias: float = 0.70
    batch_size: int = 8
    accumulate: int = 4
    epochs: int = 3
    warm_up: float = 0.1
    seed: str = "order"

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a mapping; names that are no settings are ignored, values take the setting's type."""
        known = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        return cls(**{k: known[k](v) for k, v in values.items() if k in known and v is not None})

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    def override(self, explicit: bool = False, **values) -> Settings:
        """With other values. Those that are zero or empty do not apply, unless ``explicit``; None never does."""
        return self.of(dataclasses.asdict(self) | {k: v for k, v in values.items() if v is not None and (v or explicit)})

    def as_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)
