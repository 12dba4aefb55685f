"""The client a model is called through, a deterministic stand-in, and calls as columns.

Clients are built on the executors, once a worker and profile; what travels is the
factory. Hooks run around every call, in the order of their priority.
"""

from __future__ import annotations

import base64
import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Client(Protocol):
    """What a provider offers; every method takes and returns plain values."""

    def chat(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float = 0.2) -> str: ...
    def summarize(self, text: str, system: str | None = None, max_tokens: int | None = None) -> str: ...
    def vision(self, prompt: str, image: bytes, mime: str) -> str: ...
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def transcribe(self, audio: bytes, name: str, prompt: str | None = None, language: str | None = None) -> str: ...


class StubClient:
    """Answers that follow from the question alone, for tests and dry runs."""

    def __init__(self, dimensions: int = 16, answers: dict[str, str] | None = None) -> None:
        self.dimensions, self.answers = dimensions, answers or {}

    def chat(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float = 0.2) -> str:
        return next((a for sign, a in self.answers.items() if sign in prompt), "stub:" + hashlib.sha256(prompt.encode()).hexdigest()[:16])

    def summarize(self, text: str, system: str | None = None, max_tokens: int | None = None) -> str:
        return self.answers.get("summarize") or " ".join(text.split()[: max_tokens or 40])

    def vision(self, prompt: str, image: bytes, mime: str) -> str:
        size = len(image)
        return f"<detailed_description>{mime} of {size} bytes</detailed_description><caption>{mime}</caption>"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 60 & 1 else -1.0
            out.append(v)
        return out

    def transcribe(self, audio: bytes, name: str, prompt: str | None = None, language: str | None = None) -> str:
        return f"transcript of {name}, {len(audio)} bytes"


class JsonClient:
    """A provider that speaks JSON over a given transport (url, payload) -> answer; adapters differ in paths and shapes."""

    def __init__(self, transport: Callable[[str, dict[str, Any]], dict[str, Any]], chat_model: str, embed_model: str, adapter: Adapter | None = None, batch: int = 25) -> None:
        self.send, self.chat_model, self.embed_model, self.adapter, self.batch = transport, chat_model, embed_model, adapter or Adapter(), batch

    def chat(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float = 0.2) -> str:
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        payload: dict[str, Any] = {"model": self.chat_model, "messages": messages, "temperature": temperature}
        return self.adapter.text(self.send(self.adapter.chat_path, payload | ({"max_tokens": max_tokens} if max_tokens else {})))

    def summarize(self, text: str, system: str | None = None, max_tokens: int | None = None) -> str:
        return self.chat(text, system or "Summarize the text in one short paragraph.", max_tokens)

    def vision(self, prompt: str, image: bytes, mime: str) -> str:
        url = f"data:{mime};base64,{base64.b64encode(image).decode()}"
        content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]
        return self.adapter.text(self.send(self.adapter.chat_path, {"model": self.chat_model, "messages": [{"role": "user", "content": content}]}))

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            out += self.adapter.vectors(self.send(self.adapter.embed_path, {"model": self.embed_model, "input": texts[at : at + self.batch]}))
        return out

    def transcribe(self, audio: bytes, name: str, prompt: str | None = None, language: str | None = None) -> str:
        payload = {"file": base64.b64encode(audio).decode(), "name": name, "prompt": prompt, "language": language}
        return str(self.send(self.adapter.audio_path, payload).get("text", ""))


@dataclass(frozen=True)
class Adapter:
    """Where a provider listens and where its answers keep the result."""

    chat_path: str = "/chat/completions"
    embed_path: str = "/embeddings"
    audio_path: str = "/audio/transcriptions"

    def text(self, answer: dict[str, Any]) -> str:
        return answer["choices"][0]["message"]["content"] or ""

    def vectors(self, answer: dict[str, Any]) -> list[list[float]]:
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x.get("index", 0))]


@dataclass(frozen=True)
class Call:
    """One call, as hooks and the call log see it."""

    operation: str
    profile: str = "default"
    provider: str = ""
    model: str = ""
    step_id: str = ""
    status: str = ""
    request_hash: str | None = None
    response_hash: str | None = None
    items: int = 0
    chars: int = 0
    dimensions: int | None = None
    seconds: float = 0.0
    error: str | None = None


@dataclass(frozen=True)
class CallFilter:
    """Which calls a hook is for; empty sets let all pass, names are compared without case but for steps."""

    operations: frozenset[str] = frozenset()
    step_ids: frozenset[str] = frozenset()
    providers: frozenset[str] = frozenset()
    models: frozenset[str] = frozenset()
    statuses: frozenset[str] = frozenset()

    @classmethod
    def of(cls, given: CallFilter | dict[str, Any] | None) -> CallFilter:
        """From a mapping; the singular of a name will do, and one text for a set."""
        if given is None or isinstance(given, cls):
            return given or cls()
        plural = {"operation": "operations", "step_id": "step_ids", "provider": "providers", "model": "models", "status": "statuses"}
        out = {}
        for name, value in given.items():
            name = plural.get(name, name)
            some = [value] if isinstance(value, str) else list(value or ())
            out[name] = frozenset(v if name == "step_ids" else v.lower() for v in some)
        return cls(**out)

    def matches(self, call: Call) -> bool:
        pairs = ((self.operations, call.operation.lower()), (self.step_ids, call.step_id), (self.providers, call.provider.lower()), (self.models, call.model.lower()), (self.statuses, call.status.lower()))
        return all(not some or value in some for some, value in pairs)


@dataclass(order=True)
class Hook:
    priority: int
    number: int
    kind: str = field(compare=False)
    run: Callable[..., None] = field(compare=False)
    only: CallFilter = field(compare=False, default_factory=CallFilter)


class HookRegistry:
    """before, after and on_error hooks; a failing hook is logged, and raised only if ``strict``."""

    def __init__(self, strict: bool = False) -> None:
        self.strict, self.hooks, self.failures, self._next, self._lock = strict, [], [], 0, threading.Lock()

    def add(self, kind: str, run: Callable[..., None], only: CallFilter | dict[str, Any] | None = None, priority: int = 0) -> Callable[[], None]:
        """Register; the result takes the hook away again."""
        if kind not in ("before", "after", "on_error"):
            raise ValueError(kind)
        with self._lock:
            hook = Hook(priority, self._next, kind, run, CallFilter.of(only))
            self._next += 1
            self.hooks = sorted([*self.hooks, hook])

        def dispose() -> None:
            with self._lock:
                self.hooks = [h for h in self.hooks if h is not hook]

        return dispose

    def fire(self, kind: str, call: Call, *args: Any) -> None:
        for h in self.hooks:
            if h.kind == kind and h.only.matches(call):
                try:
                    h.run(call, *args)
                except Exception as e:
                    self.failures.append((kind, str(e)))
                    if self.strict:
                        raise

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "_lock"}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        self._lock = threading.Lock()


def _hash(texts: list[str]) -> str | None:
    some = [t for t in texts if t]
    return hashlib.sha256("".join(t + "\0" for t in some).encode()).hexdigest() if some else None


class Instrumented:
    """A client whose calls are measured, shown to hooks and kept in ``log``."""

    def __init__(self, client: Client, hooks: HookRegistry | None = None, **about: str) -> None:
        self.client, self.hooks, self.about, self.log = client, hooks or HookRegistry(), about, []

    def call(self, operation: str, *args: Any, **more: Any) -> Any:
        texts = args[0] if operation == "embed" else [a for a in args if isinstance(a, str)]
        call = Call(operation, request_hash=_hash(texts), items=len(texts), chars=sum(map(len, texts)), **self.about)
        self.hooks.fire("before", call)
        began = time.perf_counter()
        try:
            answer = getattr(self.client, operation)(*args, **more)
        except Exception as e:
            call = replace(call, status="error", error=str(e), seconds=time.perf_counter() - began)
            self.log.append(call)
            self.hooks.fire("on_error", call, e)
            raise
        vectors = answer if operation == "embed" else []
        call = replace(call, status="success", seconds=time.perf_counter() - began, response_hash=None if vectors else _hash([answer]), dimensions=len(vectors[0]) if vectors else None)
        self.log.append(call)
        self.hooks.fire("after", call, answer)
        return answer


class ClientFactory:
    """Builds clients by profile, once a process."""

    _built: dict[tuple[int, str], Any] = {}

    def __init__(self, profiles: dict[str, Callable[[], Client]], hooks: HookRegistry | None = None) -> None:
        if "default" not in profiles:
            raise ValueError("a profile named default is needed")
        self.profiles, self.hooks, self.ident = profiles, hooks, id(self)

    def get(self, profile: str = "default", step_id: str = "") -> Instrumented:
        if profile not in self.profiles:
            raise KeyError(f"unknown profile {profile!r}")
        key = (self.ident, profile)
        if key not in self._built:
            self._built[key] = self.profiles[profile]()
        return Instrumented(self._built[key], self.hooks, profile=profile, step_id=step_id)

    def chat(self, prompt: Column, profile: str = "default", system: str | None = None) -> Column:
        """The answer to every prompt; null for null."""

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = self.get(profile)
            for b in batches:
                yield b.map(lambda p: client.call("chat", p, system), na_action="ignore")

        return run.asNondeterministic()(prompt)  # a model is asked once, wherever the answer is used

    def embed(self, text: Column, profile: str = "default") -> Column:
        """The vector of every text, a batch of texts a call; null for null and blank."""

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = self.get(profile)
            for b in batches:
                some = b.notna() & (b.fillna("").str.strip() != "")
                out = pd.Series([None] * len(b), index=b.index, dtype=object)
                if some.any():
                    out[some] = pd.Series(client.call("embed", b[some].tolist()), index=b.index[some])
                yield out

        return run.asNondeterministic()(text)

    def media(self, content: Column, name: Column, operation: str, prompt: str = "", profile: str = "default") -> Column:
        """vision or transcribe over binary contents."""
        kinds = {"png": "image/png", "gif": "image/gif", "webp": "image/webp"}

        @F.pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            client = self.get(profile)
            for data, names in batches:
                out = []
                for d, n in zip(data, names, strict=True):
                    if d is None:
                        out.append(None)
                    elif operation == "vision":
                        out.append(client.call("vision", prompt, bytes(d), kinds.get(str(n).rsplit(".", 1)[-1].lower(), "image/jpeg")))
                    else:
                        out.append(client.call("transcribe", bytes(d), str(n), prompt or None))
                yield pd.Series(out)

        return run.asNondeterministic()(content, name)


def call_statistics(log: DataFrame) -> DataFrame:
    """Per operation of a call log: calls, failures, characters sent and mean time."""
    return log.groupBy("operation").agg(F.count("*").alias("n_calls"), F.count_if(F.col("status") == "error").alias("n_errors"), F.sum("chars").alias("chars"), F.avg("seconds").alias("avg_seconds"))


def stub_factory(dimensions: int = 16, answers: dict[str, str] | None = None) -> ClientFactory:
    return ClientFactory({"default": lambda: StubClient(dimensions, answers)})


def to_json(value: Any) -> str:
    """Structured tool input as sorted JSON, as its hash wants it."""
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


@F.udf(T.StringType(), useArrow=False)
def structured_call_hash(tool: str, given: str, output: str) -> str | None:
    """Hash of a call whose input is JSON: keys sorted, spaces after commas and colons."""
    if tool is None or output is None:
        return None
    try:
        given = to_json(json.loads(given)) if given and given.lstrip()[:1] == "{" else given
    except ValueError:
        pass
    return hashlib.md5(f"{tool}|{given}|{output}".encode()).hexdigest()
