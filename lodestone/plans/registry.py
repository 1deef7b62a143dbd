"""Named operations, and what is told about their runs."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import catalog, patch, retrieval, validate
from lodestone.plans import reconcile, search

Listener = Callable[["Event"], None]


@dataclass(frozen=True)
class Event:
    run: str
    operation: str
    kind: str  # started, rows, completed or failed
    at: float
    detail: str = ""


class Registry:
    """Operations by name. Listeners hear of every run; one that fails doesn't stop the others or the run."""

    def __init__(self):
        self.operations: dict[str, Callable[..., Any]] = {}
        self.listeners: list[Listener] = []
        self._runs = itertools.count(1)

    def register(self, name: str, function: Callable[..., Any] | None = None):
        if function is None:
            return lambda f: self.register(name, f)
        if name in self.operations:
            raise ValueError(f"{name} is registered already")
        self.operations[name] = function
        return function

    def _tell(self, run: str, name: str, kind: str, detail: str = "") -> None:
        for listener in self.listeners:
            try:
                listener(Event(run, name, kind, time.time(), detail))
            except Exception:  # noqa: BLE001 - a listener's own failure
                continue

    def run(self, spark: SparkSession, name: str, *args, **kwargs):
        """Run an operation in a job group of its own, so that ``spark.sparkContext.cancelJobGroup(run)`` ends it."""
        run = f"op-{next(self._runs)}"
        spark.sparkContext.setJobGroup(run, name, interruptOnCancel=True)
        self._tell(run, name, "started")
        try:
            out = self.operations[name](*args, **kwargs)
        except Exception as e:
            self._tell(run, name, "failed", str(e).splitlines()[0] if str(e) else type(e).__name__)
            raise
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        self._tell(run, name, "completed", ", ".join(out.columns) if isinstance(out, DataFrame) else "")
        return out


registry = Registry()
for _name, _function in {
    "reconcile": reconcile.reconcile, "search": search.search, "context": search.context, "assemble-context": retrieval.assemble_context,
    "validate": validate.validate, "repair-plan": validate.repair_plan, "patch": patch.patched, "find-document": catalog.find, "next-code": catalog.next_code,
    "tags": catalog.tags, "type-listing": catalog.type_listing, "dashboard": catalog.dashboard, "package-plan": catalog.package_plan, "prompt": catalog.prompt_bodies,
}.items():
    registry.register(_name, _function)
