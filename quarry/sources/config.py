"""Configuration: profiles, the project's file, embedding models."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    """A preset of Spark settings for the size of a machine."""

    name: str
    shuffle_partitions: int
    arrow_rows: int
    batch: int

    def conf(self) -> dict[str, str]:
        return {"spark.sql.shuffle.partitions": str(self.shuffle_partitions), "spark.sql.execution.arrow.maxRecordsPerBatch": str(self.arrow_rows), "spark.sql.adaptive.enabled": "true"}


PROFILES = {p.name: p for p in (Profile("light", 4, 256, 8), Profile("default", 8, 1024, 16), Profile("heavy", 64, 4096, 32))}


@dataclass
class SearchConfig:
    default_top_k: int = 10
    rrf_k: float = 60.0
    bm25_weight: float = 0.5
    excerpt_lines: int | None = None
    dedupe: bool = True
    dedupe_threshold: float = 0.5


@dataclass
class IndexConfig:
    max_file_size: int = 1 << 20
    extensions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    respect_gitignore: bool = True
    lossy_utf8: bool = True


@dataclass
class Config:
    profile: str = "default"
    model: str = "bytes-384"
    index: IndexConfig = field(default_factory=IndexConfig)
    search: SearchConfig = field(default_factory=SearchConfig)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        with open(path, "rb") as f:
            return cls.of(tomllib.load(f))

    @classmethod
    def load_or_default(cls, path: str | Path) -> Config:
        return cls.load(path) if Path(path).is_file() else cls()

    @classmethod
    def of(cls, data: dict) -> Config:
        out = cls(**{k: v for k, v in data.items() if k in ("profile", "model")})
        for name in ("index", "search"):
            part = getattr(out, name)
            known = {f.name for f in fields(part)}
            for k, v in data.get(name, {}).items():
                if k in known:
                    setattr(part, k, v)
        if out.profile not in PROFILES:
            raise ValueError(f"unknown profile: {out.profile}")
        return out

    def dump(self) -> str:
        """As TOML."""
        def line(k: str, v) -> str:
            return f"{k} = {json.dumps(v)}"

        top = [line("profile", self.profile), line("model", self.model)]
        for name in ("index", "search"):
            top += ["", f"[{name}]"] + [line(k, v) for k, v in asdict(getattr(self, name)).items() if v is not None]
        return "\n".join(top) + "\n"


@dataclass(frozen=True)
class Model:
    """An embedding model; without a ``path`` it is computed from bytes, with one by ONNX Runtime."""

    model_id: str
    dimensions: int
    max_seq_len: int = 256
    path: str | None = None
    tokenizer: str | None = None
    sha256: str | None = None


class ModelRegistry:
    def __init__(self, models: list[Model] | None = None, default: str = "bytes-384"):
        self.models = {m.model_id: m for m in models or [Model("bytes-384", 384), Model("bytes-64", 64)]}
        self.default = default

    def register(self, model: Model) -> None:
        self.models[model.model_id] = model

    def get(self, model_id: str) -> Model | None:
        return self.models.get(model_id)

    def default_model(self) -> Model:
        return self.models[self.default]

    def list(self) -> list[Model]:
        return sorted(self.models.values(), key=lambda m: m.model_id)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps({"default": self.default, "models": [asdict(m) for m in self.list()]}, indent=1))

    @classmethod
    def load(cls, path: str | Path) -> ModelRegistry:
        data = json.loads(Path(path).read_text())
        return cls([Model(**m) for m in data["models"]], data["default"])
