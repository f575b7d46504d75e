"""Settings read once on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from typing import Any

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class Settings:
    """Each field is taken from ``ROSTERLAKE_<NAME>``; a value that can't be read as the field's type gives the default."""

    environment: str = "development"
    pool: str = ""
    pool_cap: int = 200
    top: int = 12
    strict: bool = True
    fingerprint_secret: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        return cls(**{f.name: _read(env.get(f"ROSTERLAKE_{f.name.upper()}"), f.default) for f in fields(cls)})


def _read(raw: str | None, default: Any) -> Any:
    if raw is None:
        return default
    text = raw.strip()
    if isinstance(default, bool):
        return True if text.lower() in _TRUE else False if text.lower() in _FALSE else default
    try:
        return type(default)(text)
    except ValueError:
        return default
