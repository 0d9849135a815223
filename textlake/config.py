"""Engine settings, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from textlake.functions.charset import lookup

DEFAULT_THRESHOLD = 64 << 20


@dataclass(frozen=True)
class EngineConfig:
    """default_encoding is used for new files; above memory_threshold bytes detection reads samples."""

    default_encoding: str = "windows-1251"
    memory_threshold: int = DEFAULT_THRESHOLD

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> EngineConfig:
        """TEXTLAKE_DEFAULT_ENCODING and TEXTLAKE_MEMORY_THRESHOLD; values that make no sense are ignored."""
        env = os.environ if env is None else env
        encoding = lookup(env.get("TEXTLAKE_DEFAULT_ENCODING", ""))
        try:
            threshold = int(env.get("TEXTLAKE_MEMORY_THRESHOLD", ""))
        except ValueError:
            threshold = 0
        return cls(encoding.name if encoding else cls.default_encoding, threshold if threshold > 0 else DEFAULT_THRESHOLD)
