"""The colour-difference algorithms by name."""

from __future__ import annotations

import json
from enum import Enum


class Algorithm(str, Enum):
    DELTA_E_76 = "delta-e-76"
    CIE94 = "cie94"
    CIEDE2000 = "ciede2000"
    CIEDE2000_EXACT = "ciede2000-exact"

    def __str__(self) -> str:
        return self.value

    @classmethod
    def default(cls) -> Algorithm:
        return cls.CIEDE2000_EXACT

    @classmethod
    def parse(cls, word: str) -> Algorithm:
        """By word, in any ASCII case and without trimming."""
        for a in cls:
            if word.isascii() and word.lower() == a.value:
                return a
        raise ValueError(f"unknown algorithm {word!r}; expected one of {', '.join(a.value for a in cls)}")

    def to_json(self) -> str:
        return json.dumps(self.value)

    @classmethod
    def from_json(cls, text: str) -> Algorithm:
        value = json.loads(text)
        if not isinstance(value, str):
            raise ValueError("an algorithm is a JSON string")
        return cls.parse(value)
