"""Settings and the registry of embedding and answering providers."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column

from tessella.functions.vectors import digest_embedding, hashed_embedding
from tessella.operators.prompt import echo_answer, extractive_answer
from tessella.operators.rerank import reranker_name

_TRUE = frozenset("on true yes y 1".split())


@dataclass(frozen=True)
class Settings:
    store: str = "stores/knowledge"
    text_size: int = 300
    text_overlap: int = 50
    parent_child: bool = False
    provider: str = "hashed"
    embedding_dim: int = 128
    candidates: int = 100
    top_k: int = 20
    reranker: str = "cross_encoder"
    relevance_weight: float = 0.95
    raw_weight: float = 0.05
    late_query_tokens: int = 32
    late_chunk_tokens: int = 180
    late_dim: int = 64
    memory: int = 10
    acl: str = "public"

    def checked(self) -> Settings:
        """Names in their normal form; unknown ones are errors."""
        provider(self.provider)
        if self.top_k <= 0 or self.candidates <= 0:
            raise ValueError("top_k and candidates must be positive")
        return replace(self, reranker=reranker_name(self.reranker))


def _parsed(kind: str, text: str, default: Any) -> Any:
    try:
        if kind == "bool":
            return text.strip().lower() in _TRUE
        return {"int": int, "float": float}.get(kind, str)(text.strip())
    except ValueError:
        return default


def read_env_file(path: str) -> dict[str, str]:
    """KEY=value lines; blanks, comments, ``export`` and quotes are understood; a missing file is empty."""
    out: dict[str, str] = {}
    if not os.path.isfile(path):
        return out
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, sep, value = line.strip().removeprefix("export ").partition("=")
            if sep and key and not key.startswith("#"):
                value = value.strip()
                out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load_settings(env_files: tuple[str, ...] = (), env: Mapping[str, str] | None = None, prefix: str = "TESSELLA_") -> Settings:
    """Defaults, then files in order, then the environment; values that can't be read keep their default."""
    values: dict[str, str] = {}
    for path in env_files:
        values.update(read_env_file(path))
    values.update(os.environ if env is None else env)
    base = Settings()
    found = {f.name: _parsed(str(f.type), values[prefix + f.name.upper()], getattr(base, f.name)) for f in fields(base) if values.get(prefix + f.name.upper(), "").strip()}
    return replace(base, **found)


@dataclass(frozen=True)
class Provider:
    """embed(text column, dimension) and answer(messages column), each giving a column."""

    embed: Callable[[Column, int], Column] | None = None
    answer: Callable[[Column], Column] | None = None

    def require_embed(self) -> Callable[[Column, int], Column]:
        if self.embed is None:
            raise RuntimeError("this provider has no embedding")
        return self.embed

    def require_answer(self) -> Callable[[Column], Column]:
        if self.answer is None:
            raise RuntimeError("this provider gives no answers")
        return self.answer


_PROVIDERS: dict[str, Provider] = {}


def _name(name: str) -> str:
    key = name.strip().lower()
    if not key:
        raise ValueError("a provider needs a name")
    return key


def register_provider(name: str, value: Provider, overwrite: bool = False) -> None:
    if not isinstance(value, Provider):
        raise TypeError("a Provider is expected")
    if _name(name) in _PROVIDERS and not overwrite:
        raise ValueError(f"provider {name!r} is registered already")
    _PROVIDERS[_name(name)] = value


def unregister_provider(name: str) -> None:
    _PROVIDERS.pop(_name(name), None)


def list_providers() -> list[str]:
    return sorted(_PROVIDERS)


def provider(choice: str | Provider | Mapping[str, Any]) -> Provider:
    """A provider by object, by name, or by parts: {"embed": ..., "answer": ...}, each a function or a name."""
    if isinstance(choice, Provider):
        return choice
    if isinstance(choice, Mapping):
        unknown = sorted(set(choice) - {"embed", "answer", "name"})
        if unknown:
            raise ValueError(f"unknown provider parts: {unknown}")
        base = provider(choice["name"]) if "name" in choice else Provider()
        part = lambda kind: getattr(provider(choice[kind]), kind) if isinstance(choice.get(kind), str) else choice.get(kind)
        built = Provider(part("embed") or base.embed, part("answer") or base.answer)
        for f in (built.embed, built.answer):
            if f is not None and not callable(f):
                raise TypeError("a provider's part must be callable")
        return built
    if not isinstance(choice, str):
        raise TypeError("a provider is chosen by name, object or mapping")
    if _name(choice) not in _PROVIDERS:
        raise ValueError(f"unknown provider {choice!r}; known: {', '.join(list_providers())}. Register one, pass one, or use an offline one; nothing stands in silently.")
    return _PROVIDERS[_name(choice)]


register_provider("hashed", Provider(hashed_embedding, extractive_answer))
register_provider("mock", Provider(digest_embedding, echo_answer))
