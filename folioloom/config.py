"""Settings: a YAML file, environment variables and defaults, in this order of precedence."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

# fixed values: what counts as no value
MISSING = frozenset({"", "none", "null", "todo", "changeme", "your-key-here", "your_api_key"})
FILE = "config.yaml"
ENVIRONMENT = "FOLIOLOOM_CONFIG"


def is_missing(value: object) -> bool:
    return value is None or (isinstance(value, str) and value.strip().lower() in MISSING)


def project_root(start: Path | None = None) -> Path:
    """The nearest folder upwards that has a config file or a repository; else the current one."""
    here = (start or Path.cwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / FILE).exists() or (p / ".git").exists()), here)


def resolved(path: str | os.PathLike, root: Path) -> Path:
    """An absolute path as it is, another one below ``root``."""
    return root / Path(path)


def relative(path: str | os.PathLike | None, root: Path) -> str:
    """``path`` from ``root`` with forward slashes; outside of it the whole path; nothing for a blank one."""
    if path is None or not str(path).strip():
        return ""
    whole, base = resolved(path, root).resolve(), root.resolve()
    return (whole.relative_to(base) if whole.is_relative_to(base) else whole).as_posix()


# fixed values: names of modalities, of montage kinds, and of servers that an OCR run may use, with their short names
MODALITIES = ("text", "table", "image")
MONTAGES = ("table", "image")
BACKENDS = ("vllm-server", "sglang-server", "fastdeploy-server", "mlx-vlm-server", "llama-cpp-server")
SHORT_BACKENDS = {"vllm": "vllm-server", "sglang": "sglang-server", "fastdeploy": "fastdeploy-server"}
NO_BACKEND = frozenset({"", "0", "false", "local", "none", "null", "off"})


def one_of(value: object, allowed: tuple[str, ...], what: str) -> str:
    """``value`` trimmed and in lower case, if it is allowed."""
    name = str(value or "").strip().lower()
    if name not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return name


def document_id_of(value: object) -> str:
    name = str(value or "").strip()
    if not name:
        raise ValueError("a document id is needed")
    return name


def backend_of(value: str | None) -> str | None:
    """The server that an OCR run uses, or None for a local run."""
    name = (value or "").strip()
    return None if name.lower() in NO_BACKEND else one_of(SHORT_BACKENDS.get(name, name), BACKENDS, "the backend")


def switch_of(value: object) -> bool:
    """A switch given as a word; anything but a clear yes or no is an error."""
    name = str(value).strip().lower()
    if name in ("1", "true", "yes", "y", "on"):
        return True
    if name in ("0", "false", "no", "n", "off"):
        return False
    raise ValueError(f"{value!r} is neither yes nor no")


@dataclass(frozen=True)
class Config:
    values: Mapping[str, object] = field(default_factory=dict)
    path: Path | None = None

    @classmethod
    def load(cls, path: str | os.PathLike | None = None) -> "Config":
        """The explicit file, else the one the environment names, else the project's; none is fine.

        A template (``*.example.*``) is no configuration and is refused.
        """
        chosen = path or os.environ.get(ENVIRONMENT)
        found = Path(chosen).expanduser() if chosen else project_root() / FILE
        if ".example" in found.name:
            raise ValueError(f"{found} is a template; copy it first")
        if not found.exists():
            if chosen:
                raise FileNotFoundError(found)
            return cls()
        import yaml

        return cls(yaml.safe_load(found.read_text(encoding="utf-8")) or {}, found)

    def get(self, key: str, default: object = None) -> object:
        """A dotted key of the file, else the variable of its upper-case name, else the default."""
        value: object = self.values
        for part in key.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        if is_missing(value):
            value = os.environ.get(re.sub(r"\W", "_", key).upper())
        return default if is_missing(value) else value

    def section(self, name: str) -> dict:
        value = self.values.get(name)
        return dict(value) if isinstance(value, Mapping) else {}

    def integer(self, key: str, default: int) -> int:
        return int(self.get(key, default))

    def number(self, key: str, default: float) -> float:
        return float(self.get(key, default))


@dataclass(frozen=True)
class Retrieval:
    """Candidates, thresholds and caps of retrieval; every value is checked."""

    candidates: Mapping[str, int]
    thresholds: Mapping[str, float]
    caps: Mapping[str, int]
    least_text: int = 6

    def __post_init__(self) -> None:
        for name in ("text", "table", "image"):
            if name not in self.candidates or name not in self.thresholds:
                raise ValueError(f"retrieval settings lack {name}")
            if self.candidates[name] < 1:
                raise ValueError(f"retrieval needs at least one candidate for {name}")

    @classmethod
    def of(cls, config: Config) -> "Retrieval":
        names = ("text", "table", "image")
        k = dict(zip(names, (15, 5, 5)))
        t = dict(zip(names, (0.70, 0.65, 0.55)))
        return cls(
            {n: config.integer(f"retrieval.candidate_k.{n}", k[n]) for n in names}, {n: config.number(f"retrieval.thresholds.{n}", t[n]) for n in names},
            {"table": config.integer("retrieval.max_table_chunks", 4), "image": config.integer("retrieval.max_image_chunks", 3)}, config.integer("retrieval.min_text_chunks", 6),
        )
