"""Settings from environment variables with a prefix, typed by their defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "CORPUSMILL_"
_WORDS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


@dataclass(frozen=True)
class Settings:
    store: str = ""
    base_url: str = "https://www.certhaven.example/"
    tokenizer_folder: str = "/opt/tokenizers"
    embedding_model: str = "certhaven-embed-64"
    embedding_dim: int = 64
    batch_size: int = 128
    request_timeout: float = 60.0
    log_json: bool = False


def load(environment: Mapping[str, str] | None = None) -> Settings:
    """The settings; a value that does not fit its type is an error that names the variable and not the value."""
    environment = os.environ if environment is None else environment
    found = {}
    for field in fields(Settings):
        name = PREFIX + field.name.upper()
        text = environment.get(name)
        if text is None:
            continue
        kind = type(field.default)
        try:
            found[field.name] = _WORDS[text.strip().lower()] if kind is bool else kind(text.strip())
        except (KeyError, ValueError):
            raise ValueError(f"{name} must be of type {kind.__name__}") from None
    return Settings(**found)
