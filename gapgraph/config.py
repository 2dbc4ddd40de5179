"""Settings: defaults, environment variables GAPGRAPH_*, and their valid ranges."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Providers and the model each uses unless one is set (fixed values).
DEFAULT_MODELS = {
    "ollama": "llama3.1",
    "openai": "gpt-4o",
    "anthropic": "claude-sonnet-4-5-20250929",
    "groq": "llama-3.1-70b-versatile",
    "mistral": "mistral-large-latest",
    "together_ai": "meta-llama/Meta-Llama-3.1-70B-Instruct-Turbo",
    "offline": "cue-rules",
}
#: Log levels (fixed values).
_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def read_dotenv(path: str) -> dict[str, str]:
    """The NAME=value lines of a file, quotes around values removed; nothing if there is no file."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = [line.strip().removeprefix("export ") for line in f]
    except FileNotFoundError:
        return {}
    pairs = (line.partition("=") for line in lines if "=" in line and not line.startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, _, value in pairs}


@dataclass(frozen=True)
class Settings:
    provider: str = "ollama"
    model: str | None = None
    temperature: float = 0.1
    max_retries: int = 3
    min_confidence: float = 0.5
    min_papers_for_edge: int = 1
    max_hypotheses: int = 10
    log_level: str = "INFO"
    api_base: str | None = None
    api_key: str | None = None
    api_host: str = "127.0.0.1"
    api_port: int = 8000

    def __post_init__(self):
        object.__setattr__(self, "log_level", self.log_level.upper())
        for name, low, high in (("temperature", 0, 2), ("max_retries", 1, 10), ("min_confidence", 0, 1), ("min_papers_for_edge", 1, None), ("max_hypotheses", 1, 100)):
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else "") + f", not {value}")
        if self.log_level not in _LEVELS:
            raise ValueError(f"log_level must be one of {', '.join(_LEVELS)}")
        if self.provider not in DEFAULT_MODELS:
            raise ValueError(f"provider must be one of {', '.join(DEFAULT_MODELS)}")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, dotenv: str = ".env") -> Settings:
        """Settings from variables GAPGRAPH_<NAME>, and from the file ``dotenv`` where a variable is unset; unknown ones are ignored."""
        env = {**read_dotenv(dotenv), **os.environ} if env is None else dict(env)
        found = {}
        for f in fields(cls):
            raw = env.get(f"GAPGRAPH_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default) if f.default is not None else str
                found[f.name] = kind(raw)
        return cls(**found)

    @property
    def model_id(self) -> str:
        """The model's name as a client takes it; local models get their provider's prefix once."""
        model = self.model or DEFAULT_MODELS[self.provider]
        return f"ollama/{model}" if self.provider == "ollama" and not model.startswith("ollama/") else model
