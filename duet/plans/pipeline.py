"""Runs named stages in order, DataFrame to DataFrame, with the selection and the failure rules of a study's pipeline."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def select_stages(stages: list[Stage], start: str | None = None, only: list[str] | None = None, skip: list[str] | None = None) -> list[Stage]:
    """The stages from ``start`` on, of these only the named ones, without the skipped ones."""
    names = [n for n, _ in stages]
    for n in [*([start] if start else []), *(only or []), *(skip or [])]:
        if n not in names:
            raise ValueError(f"no stage named {n}")
    chosen = stages[names.index(start) if start else 0 :]
    return [s for s in chosen if (not only or s[0] in only) and s[0] not in (skip or [])]


def run(stages: list[Stage], tables: dict[str, DataFrame], hard: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables with each stage's output, failures). A failing hard stage stops the run; others are listed and passed over."""
    failed: dict[str, str] = {}
    for name, stage in stages:
        try:
            tables = {**tables, name: stage(tables)}
        except Exception as e:
            if name in hard:
                raise
            failed[name] = str(e)
    return tables, failed


def arguments(argv: list[str]) -> argparse.Namespace:
    """--from STAGE, --only STAGE..., --skip STAGE..."""
    p = argparse.ArgumentParser()
    p.add_argument("--from", dest="start")
    p.add_argument("--only", nargs="*")
    p.add_argument("--skip", nargs="*")
    return p.parse_args(argv)
