"""Operators for preparing language-model training text: one module for each, with its query and SQL.

``queries()`` and ``oracle_sql()`` gather what the modules register. Nothing outside this subpackage imports it
but ``__spark_entry__`` (guarded) and ``corpus_pipeline``.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("minhash", "licenses", "ann", "toxicity", "linededup", "quality", "bpe", "secrets", "chat", "decontaminate", "suffix", "ballkmeans", "repair")


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in import_module(f"talus.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    """A module gives its SQL as text or as a function that makes it."""
    found = {name: sql for m in MODULES for name, sql in getattr(import_module(f"talus.llm.{m}"), "ORACLES", {}).items()}
    return {name: sql if isinstance(sql, str) else sql() for name, sql in found.items()}
