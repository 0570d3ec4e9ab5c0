"""Project configuration on the driver: languages, directories, translatable files, model services."""

from __future__ import annotations

import json
import shutil
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from lexitile.functions.keys import DIR_SUFFIX, LANGUAGES

FOLDER, FILE = ".lexitile", "config.json"


class ProjectError(Exception):
    """A request the project's state does not allow."""


class NotFound(ProjectError):
    """No project, file or directory there."""


def language(name: str) -> str:
    """Full name of a language written in any case."""
    for n in LANGUAGES:
        if n.lower() == name.strip().lower():
            return n
    raise ProjectError(f"unknown language {name!r}")


def find_upwards(start: Path, name: str, directory: bool = True) -> Path:
    """The nearest directory or file of that name in a path or above."""
    start = start.resolve()
    for p in (start, *start.parents):
        q = p / name
        if q.is_dir() if directory else q.is_file():
            return q
    raise NotFound(f"no {name} in {start} or above")


@dataclass
class Config:
    name: str
    source: dict | None = None
    targets: list[dict] = field(default_factory=list)
    translatable: list[str] = field(default_factory=list)
    service: str = "echo"
    model: str = "echo"
    reasoning_service: str | None = None
    reasoning_model: str | None = None
    typst_args: dict[str, list[str]] = field(default_factory=lambda: {"ex": ["info"]})


class Project:
    """A directory tree with a configuration; paths are kept relative to its root."""

    def __init__(self, root: Path, config: Config):
        self.root, self.config = root.resolve(), config

    @classmethod
    def init(cls, root: Path, name: str) -> Project:
        folder = root / FOLDER
        if folder.exists():
            raise ProjectError(f"{root} is a project already")
        if not root.is_dir():
            raise NotFound(str(root))
        folder.mkdir()
        p = cls(root, Config(name))
        p.save()
        return p

    @classmethod
    def load(cls, start: Path) -> Project:
        folder = find_upwards(start, FOLDER)
        try:
            data = json.loads((folder / FILE).read_text(encoding="utf-8"))
        except FileNotFoundError as e:
            raise NotFound(str(folder / FILE)) from e
        except ValueError as e:
            raise ProjectError(f"{folder / FILE} is no JSON") from e
        known = {f.name for f in fields(Config)}
        return cls(folder.parent, Config(**{k: v for k, v in data.items() if k in known}))

    def save(self) -> None:
        (self.root / FOLDER / FILE).write_text(json.dumps(asdict(self.config), indent=2, ensure_ascii=False), encoding="utf-8")

    def _inside(self, path: Path) -> str:
        full = (path if path.is_absolute() else self.root / path).resolve()
        if not full.is_relative_to(self.root):
            raise ProjectError(f"{path} is not inside {self.root}")
        return full.relative_to(self.root).as_posix()

    @property
    def languages(self) -> list[str]:
        return ([self.config.source["lang"]] if self.config.source else []) + [t["lang"] for t in self.config.targets]

    def set_source(self, path: Path, lang: str) -> None:
        lang = language(lang)
        if lang in self.languages:
            raise ProjectError(f"{lang} is in use")
        rel = self._inside(path)
        if not (self.root / rel).is_dir():
            raise NotFound(rel)
        self.config.source = {"lang": lang, "path": rel}
        self.save()

    def add_target(self, lang: str, path: Path | None = None) -> Path:
        """A given directory replaces an earlier one; without one a new directory is made."""
        lang = language(lang)
        if not self.config.source:
            raise ProjectError("no source language")
        if lang == self.config.source["lang"]:
            raise ProjectError(f"{lang} is the source language")
        if path is not None:
            rel = self._inside(path)
            if not (self.root / rel).is_dir():
                raise NotFound(rel)
        else:
            if lang in self.languages:
                raise ProjectError(f"{lang} is a target language")
            rel = f"{self.config.name}{DIR_SUFFIX[lang]}"
            if (self.root / rel).exists():
                raise ProjectError(f"{rel} exists")
            (self.root / rel).mkdir(parents=True)
        self.config.targets = [t for t in self.config.targets if t["lang"] != lang] + [{"lang": lang, "path": rel}]
        self.save()
        return self.root / rel

    def target(self, lang: str) -> Path:
        for t in self.config.targets:
            if t["lang"] == language(lang):
                return self.root / t["path"]
        raise ProjectError(f"{lang} is no target language")

    def remove_target(self, lang: str) -> None:
        """Takes the language out and deletes its directory tree."""
        path = self.target(lang)
        self.config.targets = [t for t in self.config.targets if t["lang"] != language(lang)]
        self.save()
        if path.exists():
            shutil.rmtree(path)

    def mark(self, path: Path, translatable: bool = True) -> None:
        """Marks a source file; marking twice is the same, unmarking a file that is not marked is an error."""
        if not self.config.source:
            raise ProjectError("no source language")
        rel = self._inside(path)
        if not translatable:
            if rel not in self.config.translatable:
                raise ProjectError(f"{rel} is not marked")
            self.config.translatable.remove(rel)
        else:
            if not (self.root / rel).is_file():
                raise NotFound(rel)
            if not Path(rel).is_relative_to(self.config.source["path"]):
                raise ProjectError(f"{rel} is not in the source directory")
            if rel not in self.config.translatable:
                self.config.translatable.append(rel)
        self.save()

    def set_model(self, service: str, model: str, reasoning: bool = False) -> None:
        if reasoning:
            self.config.reasoning_service, self.config.reasoning_model = service, model
        else:
            self.config.service, self.config.model = service, model
        self.save()

    def route(self, use_reasoning: bool = False) -> tuple[str, str, str | None, str | None]:
        """Main and fallback model; the reasoning flag makes the reasoning model the main one, where there is none the usual one, and leaves no fallback."""
        c = self.config
        if use_reasoning:
            return c.reasoning_service or c.service, c.reasoning_model or c.model, None, None
        return c.service, c.model, c.reasoning_service, c.reasoning_model

    def set_typst_args(self, function: str, args: list[str]) -> None:
        name, names = function.strip().lower(), sorted({a.strip().lower() for a in args if a.strip()})
        if not name or not names:
            raise ProjectError("a function and at least one argument are needed")
        self.config.typst_args[name] = names
        self.save()

    def unset_typst_args(self, function: str) -> None:
        self.config.typst_args.pop(function.strip().lower(), None)
        self.save()

    def relative_path(self, path: Path) -> str:
        """A file's path below the first language directory that holds it."""
        rel = Path(self._inside(path))
        for d in [self.config.source, *self.config.targets]:
            if d and rel.is_relative_to(d["path"]):
                return rel.relative_to(d["path"]).as_posix()
        raise ProjectError(f"{path} is in no language directory")

    def sync_untranslatable(self) -> int:
        """Copies the files that are not translatable into every target directory; the number of copies."""
        if not self.config.source:
            raise ProjectError("no source language")
        if not self.config.targets:
            raise ProjectError("no target languages")
        src, n = self.root / self.config.source["path"], 0
        skip = set(self.config.translatable)
        for p in sorted(src.rglob("*")):
            if p.is_file() and not p.is_symlink() and p.relative_to(self.root).as_posix() not in skip:
                for t in self.config.targets:
                    to = self.root / t["path"] / p.relative_to(src)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    shutil.copy2(p, to)
                    n += 1
        return n


@dataclass(frozen=True)
class Service:
    """A model service: a callable ``(prompt, model, token) -> reply``, or ``prompt -> reply``, seconds to rest after an answer, and what identifies the caller."""

    call: object
    cooldown: float = 0.0
    token: str | None = None

    def model(self, name: str):
        """The service as ``prompt -> reply`` for one of its models."""
        import inspect

        if len(inspect.signature(self.call).parameters) < 3:
            return self.call
        call, token = self.call, self.token
        return lambda prompt: call(prompt, name, token)


SERVICES: dict[str, Service] = {}


def register_service(name: str, call, cooldown: float = 0.0, token: str | None = None) -> None:
    """Makes a model service known by name; files are never loaded by themselves."""
    SERVICES[name] = Service(call, cooldown, token)


def services() -> list[str]:
    return sorted(SERVICES)
