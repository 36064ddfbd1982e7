"""Document types that a caller adds: each brings its title, when a repository needs it, its sections and its rules.

Every plan built while a type is registered knows it: ``doc_needs`` decides it, ``section_plan`` cuts it into requests,
titles and file names follow, and ``repo_documents`` writes it. Plans are not changed afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark.sql import Column


class DocumentType(NamedTuple):
    """``when`` gives a condition over the columns of ``repo_facts`` and ``infra_score``; without one the type is only made on request.

    ``rules`` gives the rules (``codestrata.plans.documents.Rule``) from the tables of a profile. ``before`` names the
    type that this one is decided before; it comes last otherwise. A type of the name of a built-in one takes its place:
    what it leaves empty stays as it was.
    """

    name: str
    title: str
    when: Callable[[], Column] | None = None
    sections: tuple[str, ...] = ()
    rules: Callable[[Any], list] | None = None
    before: str | None = None


_added: dict[str, DocumentType] = {}


def register(added: DocumentType) -> None:
    """Adds a type, or replaces the one of its name."""
    if not added.name or not added.title:
        raise ValueError("a document type needs a name and a title")
    _added[added.name] = added


def unregister(name: str) -> None:
    del _added[name]


@contextmanager
def document_types(*types: DocumentType) -> Iterator[None]:
    """Registers types for the plans built inside the block."""
    earlier = dict(_added)
    try:
        for added in types:
            register(added)
        yield
    finally:
        _added.clear()
        _added.update(earlier)


def with_added(table: dict[str, Any], field: str) -> dict[str, Any]:
    """A table by type, with the entries of ``field`` that added types bring."""
    return {**table, **{name: getattr(added, field) for name, added in _added.items() if getattr(added, field)}}


def in_order(names: list[str]) -> list[str]:
    """Names of types with those added that are decided, each at its place."""
    out = list(names)
    for name, added in _added.items():
        if added.when is not None and name not in out:
            out.insert(out.index(added.before) if added.before in out else len(out), name)
    return out
