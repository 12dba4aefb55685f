"""Pipelines of named stages over a state of lazy DataFrames and plain values.

Stages declare what they need and give. A pipeline is checked when it is made and again while it
runs; every edit makes a new revision. Nothing here starts a Spark job: stages compose
plans, and only a stage that must decide something looks at data.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

Handler = Callable[[dict[str, Any], "Context"], Mapping[str, Any]]


@dataclass(frozen=True)
class Context:
    """What a stage may use besides the state."""

    spark: Any = None
    models: Any = None
    config: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Stage:
    name: str
    handler: Handler
    requires: frozenset[str] = frozenset()
    produces: frozenset[str] = frozenset()
    capabilities: frozenset[str] = frozenset()
    config: Mapping[str, Any] = field(default_factory=dict)

    def run(self, state: dict[str, Any], context: Context) -> dict[str, Any]:
        missing = self.requires - state.keys()
        if missing:
            raise KeyError(f"stage {self.name} lacks {sorted(missing)}")
        out = self.handler(state, replace(context, config={**context.config, **self.config}))
        if not isinstance(out, Mapping):
            raise TypeError(f"stage {self.name} must return a mapping")
        return {**state, **out}


def stage(name: str, handler: Handler, requires: str = "", produces: str = "", capabilities: str = "", **config: Any) -> Stage:
    """A stage from space-separated names."""
    return Stage(name, handler, frozenset(requires.split()), frozenset(produces.split()), frozenset(capabilities.split()), config)


class StageHooks:
    """before hooks run in order, after and on_error hooks in reverse; failures are kept, and raised only if strict."""

    def __init__(self, strict: bool = False) -> None:
        self.strict, self.failures, self._hooks, self._lock = strict, [], {"before": [], "after": [], "on_error": []}, threading.Lock()

    def add(self, kind: str, run: Callable[..., None]) -> Callable[[], None]:
        with self._lock:
            self._hooks[kind].append(run)

        def dispose() -> None:
            with self._lock:
                if run in self._hooks[kind]:
                    self._hooks[kind].remove(run)

        return dispose

    def fire(self, kind: str, *args: Any) -> None:
        some = list(self._hooks[kind])
        for run in some if kind == "before" else reversed(some):
            try:
                run(*args)
            except Exception as e:
                self.failures.append((kind, str(e)))
                if self.strict:
                    raise


def run_stages(stages: tuple[Stage, ...], state: Mapping[str, Any], context: Context, hooks: StageHooks | None = None) -> dict[str, Any]:
    """One after the other, on the driver."""
    hooks, now = hooks or StageHooks(), dict(state)
    for s in stages:
        hooks.fire("before", s, now)
        try:
            now = s.run(now, context)
        except Exception as e:
            hooks.fire("on_error", s, now, e)
            raise
        hooks.fire("after", s, now)
    return now


class Runners:
    """Ways to run stages, by name."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., dict[str, Any]]] = {"local": run_stages, "sync": run_stages}

    def register(self, name: str, runner: Callable[..., dict[str, Any]]) -> None:
        self._known[name.strip().lower()] = runner

    def resolve(self, name: str | Callable[..., dict[str, Any]] = "local") -> Callable[..., dict[str, Any]]:
        if callable(name):
            return name
        try:
            return self._known[name.strip().lower()]
        except KeyError:
            raise ValueError(f"no runner named {name!r}") from None


@dataclass(frozen=True)
class Revision:
    number: int
    stages: tuple[Stage, ...]
    given: frozenset[str]


class Pipelines:
    """Named pipelines and their revisions."""

    def __init__(self, capabilities: frozenset[str] = frozenset(), profiles: frozenset[str] = frozenset({"default"})) -> None:
        self.capabilities, self.profiles, self._all = capabilities, profiles, {}

    def register(self, name: str, stages: list[Stage], given: str = "") -> None:
        self._put(name, 1, tuple(stages), frozenset(given.split()))

    def build(self, name: str) -> tuple[Stage, ...]:
        return self._all[name].stages

    def _put(self, name: str, number: int, stages: tuple[Stage, ...], given: frozenset[str]) -> None:
        self._validate(stages, given)
        self._all[name] = Revision(number, stages, given)

    def _validate(self, stages: tuple[Stage, ...], given: frozenset[str]) -> None:
        names, have = [s.name for s in stages], set(given)
        if len(set(names)) != len(names):
            raise ValueError("two stages share a name")
        for s in stages:
            if s.capabilities - self.capabilities:
                raise ValueError(f"{s.name} needs capabilities {sorted(s.capabilities - self.capabilities)}")
            wrong = {v for k, v in s.config.items() if k.endswith("profile") and v is not None} - self.profiles
            if wrong:
                raise ValueError(f"{s.name} names unknown profiles {sorted(wrong)}")
            if s.requires - have:
                raise ValueError(f"{s.name} needs {sorted(s.requires - have)}, which no stage before it gives")
            have |= s.produces

    def _edit(self, name: str, change: Callable[[list[Stage]], list[Stage]]) -> int:
        old = self._all[name]
        self._put(name, old.number + 1, tuple(change(list(old.stages))), old.given)
        return old.number + 1

    def _at(self, stages: list[Stage], target: str) -> int:
        for i, s in enumerate(stages):
            if s.name == target:
                return i
        raise KeyError(f"no stage {target!r}")

    def configure(self, name: str, target: str, **config: Any) -> int:
        return self._edit(name, lambda ss: [replace(s, config={**s.config, **config}) if i == self._at(ss, target) else s for i, s in enumerate(ss)])

    def insert_before(self, name: str, target: str, new: Stage) -> int:
        return self._edit(name, lambda ss: [*ss[: self._at(ss, target)], new, *ss[self._at(ss, target) :]])

    def insert_after(self, name: str, target: str, new: Stage) -> int:
        return self._edit(name, lambda ss: [*ss[: self._at(ss, target) + 1], new, *ss[self._at(ss, target) + 1 :]])

    def replace(self, name: str, target: str, new: Stage) -> int:
        return self._edit(name, lambda ss: [new if i == self._at(ss, target) else s for i, s in enumerate(ss)])

    def remove(self, name: str, target: str) -> int:
        return self._edit(name, lambda ss: [s for i, s in enumerate(ss) if i != self._at(ss, target)])

    def revision_token(self) -> str:
        return "|".join(f"{n}:v{r.number}" for n, r in sorted(self._all.items()))
