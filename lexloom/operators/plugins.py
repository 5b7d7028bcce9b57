"""User plugins: functions of (text, meta, config) that score or reject a row."""

from __future__ import annotations

import importlib
import json
import multiprocessing
import resource
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "scores map<string,double>, reason string, error string"


def validate(plugins: Sequence[Mapping[str, Any]]) -> None:
    for p in plugins:
        if not p.get("name") or not p.get("path"):
            raise ValueError("a plugin needs a name and a path")
        if p.get("timeout_ms", 100) <= 0:
            raise ValueError(f"plugin {p['name']!r}: timeout_ms must be above 0")
        if p.get("memory_limit_bytes", MEMORY) <= 0:
            raise ValueError(f"plugin {p['name']!r}: memory_limit_bytes must be above 0")


def load(path: str):
    """The function that "module:name" names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


#: Bytes that a plugin may take besides what its process has at the start.
MEMORY = 16 << 20


def _serve(pipe, path: str, config: dict, memory: int) -> None:
    """A plugin's process: a dict or an error for each text and meta."""
    try:
        function = load(path)
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (now + memory, now + memory))
        pipe.send(None)
    except Exception as e:  # noqa: BLE001
        pipe.send(str(e) or type(e).__name__)
        return
    while True:
        text, meta = pipe.recv()
        try:
            out = function(text, meta, config)
            if not isinstance(out, dict):
                raise TypeError("a plugin has to return a dict")
            pipe.send((out, None))
        except MemoryError:
            pipe.send((None, "memory limit"))
        except Exception as e:  # noqa: BLE001
            pipe.send((None, str(e) or type(e).__name__))


class Process:
    """A plugin in a process of its own, which is ended when a call takes too long, whatever the plugin catches."""

    def __init__(self, plugin: Mapping[str, Any]) -> None:
        self.path, self.limit = plugin["path"], plugin.get("timeout_ms", 100) / 1000
        self.config, self.memory = json.loads(json.dumps(plugin.get("config", {}), default=str)), plugin.get("memory_limit_bytes", MEMORY)
        self.child = None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.child = context.Process(target=_serve, args=(other, self.path, self.config, self.memory), daemon=True)
        self.child.start()
        other.close()
        if (error := self.pipe.recv()) is not None:
            self.close()
            raise RuntimeError(error)

    def call(self, text: str, meta: dict) -> dict:
        if self.child is None:
            self._start()
        try:
            self.pipe.send((text, meta))
            if not self.pipe.poll(self.limit):
                self.close()
                raise TimeoutError("timeout")
            out, error = self.pipe.recv()
        except (EOFError, BrokenPipeError) as e:
            self.close()
            raise RuntimeError("the plugin's process ended, by its memory limit or by itself") from e
        if error is not None:
            raise RuntimeError(error)
        return out

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def chain(text: Column, meta: Column, plugins: Sequence[Mapping[str, Any]]) -> Column:
    """A struct of RESULT: scores in order up to the first plugin that rejects, its reason, or the error that ended the chain."""
    validate(plugins)
    given = [dict(p) for p in plugins]

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        processes = [(p["name"], Process(p)) for p in given]
        rows = []
        try:
            for t, m in zip(texts, metas):
                scores: dict[str, float] = {}
                reason = error = None
                for name, process in processes:
                    try:
                        out = process.call(t or "", json.loads(m or "{}"))
                        if out.get("score") is not None:
                            scores[name] = float(out["score"])
                        if out.get("accept") is False:
                            reason = f"plugin:{name}:{out.get('reason') or 'rejected'}"
                            break
                    except Exception as e:  # noqa: BLE001 - whatever a plugin raises makes its row an error
                        error = f"plugin {name}: {e}"
                        break
                rows.append((scores, reason, error))
        finally:
            for _, process in processes:
                process.close()
        return pd.DataFrame(rows, columns=["scores", "reason", "error"])

    return run(text, meta)
