"""Scan or index: the choice is made here, as Catalyst can't know of the index."""

from __future__ import annotations

from ..operators import search
from ..operators.grams import GramIndex
from ..sources.corpus import Corpus


class Scan:
    """The operators of ``search`` on a corpus, with the methods of an index."""

    def __init__(self, corpus: Corpus) -> None:
        self.docs = corpus.documents

    def __getattr__(self, name: str):
        return lambda *args, **named: getattr(search, name)(self.docs, *args, **named)


def source_for(corpus: Corpus, index: GramIndex | None, pattern: str) -> Scan | GramIndex:
    """An index answers any pattern but the longest, whose many lists cost more than a scan's pushed-down filter."""
    return Scan(corpus) if index is None or len(pattern) > 300 else index
