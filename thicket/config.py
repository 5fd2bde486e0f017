"""Settings: defaults, then a file of JSON, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from thicket.errors import ValidationError


@dataclass
class ModelSettings:
    provider: str = "mock"
    model: str = "mock"


@dataclass
class IndexSettings:
    ignore: list[str] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)


@dataclass
class RetrievalSettings:
    k: int = 12
    rrf_k: int = 60
    rerank: bool = True
    expansion_decay: float = 0.6
    context_token_budget: int = 12_000


@dataclass
class EditSettings:
    require_approval: bool = True
    pending_ttl_minutes: int = 60


@dataclass
class Settings:
    llm: ModelSettings = field(default_factory=ModelSettings)
    embedder: str = "hash"
    index: IndexSettings = field(default_factory=IndexSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    editing: EditSettings = field(default_factory=EditSettings)
    guidelines_file: str = "guidelines.md"
    store: str = ""


#: Least values, and for shares the greatest.
LEAST = {"k": 1, "rrf_k": 1, "context_token_budget": 500, "pending_ttl_minutes": 1, "expansion_decay": 0}
MOST = {"expansion_decay": 1}
ENVIRONMENT = {"THICKET_STORE": ("store",), "THICKET_EMBEDDER": ("embedder",), "THICKET_MODEL": ("llm", "model")}


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _fill(target: Any, values: Any, where: str, faults: list[str]) -> None:
    if not isinstance(values, dict):
        faults.append(f"{where or '(root)'}: not an object")
        return
    kinds = get_type_hints(type(target))
    known = {f.name for f in fields(target)}
    for key, value in values.items():
        name, at = _snake(key), f"{where}.{key}" if where else key
        if name not in known:
            faults.append(f"{at}: unknown")
        elif is_dataclass(getattr(target, name)):
            _fill(getattr(target, name), value, at, faults)
        else:
            kind = kinds[name]
            plain = list if "list" in str(kind) else kind
            sound = isinstance(value, (int, float) if plain is float else plain) and not (plain in (int, float) and isinstance(value, bool))
            sound = sound and (plain is not list or all(isinstance(x, str) for x in value))
            if not sound or name in LEAST and value < LEAST[name] or name in MOST and value > MOST[name]:
                faults.append(f"{at}: {value!r} is no valid value")
            else:
                setattr(target, name, value)


def load_settings(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings of a file, if it is there, over the defaults, and of the environment over both; keys in camel or snake case.

    Unknown keys, wrong types and values out of range raise ValidationError, as does a file that isn't JSON.
    """
    settings = Settings()
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            try:
                values = json.load(f)
            except ValueError as e:
                raise ValidationError(f"{path} is not valid JSON") from e
        faults: list[str] = []
        _fill(settings, values, "", faults)
        if faults:
            raise ValidationError(f"invalid settings in {path}: {'; '.join(faults)}")
    env = dict(os.environ) if env is None else env
    for name, way in ENVIRONMENT.items():
        if env.get(name):
            target: Any = settings
            for step in way[:-1]:
                target = getattr(target, step)
            setattr(target, way[-1], env[name])
    return settings
