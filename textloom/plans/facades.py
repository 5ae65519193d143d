"""One text, or a collection of texts, with methods that return plain Python values.

Results come to the driver, so they should be of a size for it; ``iter_locate`` fetches a partition at
a time, and ``operators.search`` gives DataFrames of any size. Objects don't change once made.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grams import GramIndex
from ..sources.corpus import Corpus
from ..sources.store import fresh_path
from .choice import source_for

#: Characters of a corpus that pickling brings to the driver at most; ``save`` has no limit.
PICKLED_CHARS = 1 << 28


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _string(x: str) -> str:
    if not isinstance(x, str):
        raise TypeError(f"a string is needed, not {type(x).__name__}")
    return x


class _Facade:
    """corpus: what is searched; on_disk: it is a table in the shared folder; index: of grams, or none."""

    corpus: Corpus
    on_disk: bool
    index: GramIndex | None

    @classmethod
    def of(cls, corpus: Corpus, index: GramIndex | None = None, on_disk: bool = False):
        self = object.__new__(cls)
        self.corpus, self.index, self.on_disk = corpus, index, on_disk
        return self

    def _hold(self, corpus: Corpus, on_disk: bool) -> None:
        self.on_disk, self.index = on_disk, None
        self.corpus = corpus.save(fresh_path(corpus.spark, "corpus")) if on_disk else corpus

    def indexed(self, path: str | None = None):
        """The same searches by a gram index, written under path or in the shared folder."""
        made = GramIndex.build(self.corpus, path or fresh_path(self.corpus.spark, "grams"))
        return type(self).of(self.corpus, made, self.on_disk)

    def _from(self, pattern: str):
        return source_for(self.corpus, self.index, _string(pattern))

    def save(self, path: str) -> None:
        self.corpus.save(path)

    @classmethod
    def load(cls, path: str):
        return cls.of(Corpus.load(_session(), path), on_disk=True)

    def __copy__(self):
        return type(self).of(self.corpus, self.index, self.on_disk)

    def __deepcopy__(self, memo):
        """Tables are never changed, so a copy may share them; one on disk gets a folder of its own."""
        corpus = self.corpus.save(fresh_path(self.corpus.spark, "corpus")) if self.on_disk else self.corpus
        return type(self).of(corpus, self.index, self.on_disk)

    def __reduce__(self):
        if self.on_disk:
            raise TypeError(f"__reduce__ is not supported for on-disk {type(self).__name__}")
        return type(self), (self._empty(),), self.__getstate__()

    def __getstate__(self) -> bytes:
        if self.on_disk:
            raise TypeError(f"__getstate__ is not supported for on-disk {type(self).__name__}")
        if self.corpus.stats.total_num_chars > PICKLED_CHARS:
            raise ValueError(f"the corpus has more than {PICKLED_CHARS} characters; use save")
        return pickle.dumps([r.text for r in self.corpus.items().collect()])

    def __setstate__(self, state: bytes) -> None:
        if getattr(self, "on_disk", False):
            raise TypeError(f"__setstate__ is not supported for on-disk {type(self).__name__}")
        try:
            texts = pickle.loads(state)
            self._hold(Corpus.from_texts(_session(), texts), False)
        except Exception as e:
            raise ValueError(f"the state of a {type(self).__name__} is damaged") from e

    def __str__(self) -> str:
        return repr(self)

    def __contains__(self, pattern: str) -> bool:
        return self.contains(pattern)


def _some(rows: DataFrame) -> bool:
    return bool(rows.take(1))


class TextSearch(_Facade):
    """Exact substring search in one text; offsets are code points from 0, and occurrences may overlap."""

    def __init__(self, data: str, on_disk: bool = False) -> None:
        self._hold(Corpus.from_text(_session(), data), on_disk)

    @staticmethod
    def _empty():
        return ""

    def __len__(self) -> int:
        return self.corpus.stats.total_num_chars

    def __repr__(self) -> str:
        s = self.corpus.stats
        return f"TextSearch(len={s.total_num_chars}, max_bit={s.max_bit}, on_disk={self.on_disk})"

    def item(self) -> str:
        return self.corpus.documents.select("text").first()[0]

    def contains(self, pattern: str) -> bool:
        """Whether the text holds pattern."""
        return _some(self._from(pattern).containing(pattern))

    def count(self, pattern: str) -> int:
        return self._from(pattern).count_all(pattern).first()[0]

    def locate(self, pattern: str) -> list[int]:
        """Offsets of all occurrences, ascending."""
        return sorted(r.pos for r in self._from(pattern).locate(pattern).collect())

    def iter_locate(self, pattern: str) -> Iterator[int]:
        """The same offsets one by one, in no order that is promised."""
        return (r.pos for r in self._from(pattern).locate(pattern).toLocalIterator())

    def startswith(self, prefix: str) -> bool:
        return _some(self._from(prefix).starting_with(prefix))

    def endswith(self, suffix: str) -> bool:
        return _some(self._from(suffix).ending_with(suffix))


class CollectionSearch(_Facade):
    """Exact substring search in many texts; doc ids are places in the iterable, and no match spans two texts."""

    def __init__(self, data: Iterable[str], on_disk: bool = False) -> None:
        self._hold(Corpus.from_texts(_session(), data), on_disk)

    @staticmethod
    def _empty():
        return []

    def __len__(self) -> int:
        return self.corpus.num_docs

    def __repr__(self) -> str:
        s = self.corpus.stats
        return f"CollectionSearch(num_docs={s.num_docs}, total_num_chars={s.total_num_chars}, max_bit={s.max_bit}, on_disk={self.on_disk})"

    def _known(self, doc_id: int | None) -> None:
        if doc_id is None:
            return
        if doc_id < 0:
            raise OverflowError("doc_id can't be negative")
        if doc_id >= len(self):
            raise ValueError("doc_id is out of bounds")

    def item(self) -> list[str]:
        return [r.text for r in self.corpus.items().collect()]

    def contains(self, pattern: str) -> bool:
        """Whether some document is exactly this text."""
        return _some(self._from(pattern).equal_to(pattern))

    def count_all(self, pattern: str) -> int:
        return self._from(pattern).count_all(pattern).first()[0]

    def count(self, pattern: str, doc_id: int | None = None) -> dict[int, int] | int:
        """Occurrences in each document that has any; with doc_id, in that one, which may be 0."""
        source = self._from(pattern)
        self._known(doc_id)
        rows = source.counts(pattern, doc_id=doc_id).collect()
        if doc_id is None:
            return {r.doc_id: r.n for r in rows}
        return rows[0].n if rows else 0

    def topk(self, pattern: str, k: int) -> list[tuple[int, int]]:
        """(doc_id, count) of the k documents with most occurrences; ties go to the smaller doc_id."""
        return [(r.doc_id, r.n) for r in self._from(pattern).top_k(pattern, k).collect()]

    def locate(self, pattern: str, doc_id: int | None = None) -> dict[int, list[int]] | list[int]:
        """Ascending offsets of each document that has any; with doc_id, of that one."""
        source = self._from(pattern)
        self._known(doc_id)
        rows = source.locate(pattern, doc_id=doc_id)
        if doc_id is not None:
            return sorted(r.pos for r in rows.collect())
        found = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        return {r.doc_id: r.positions for r in found.collect()}

    def iter_locate(self, pattern: str, doc_id: int | None = None) -> Iterator[tuple[int, int]] | Iterator[int]:
        """(doc_id, offset) one by one, or with doc_id offsets, in no order that is promised."""
        source = self._from(pattern)
        self._known(doc_id)
        rows = source.locate(pattern, doc_id=doc_id).toLocalIterator()
        return ((r.doc_id, r.pos) for r in rows) if doc_id is None else (r.pos for r in rows)

    def startswith(self, prefix: str) -> list[int]:
        return sorted(r.doc_id for r in self._from(prefix).starting_with(prefix).collect())

    def endswith(self, suffix: str) -> list[int]:
        return sorted(r.doc_id for r in self._from(suffix).ending_with(suffix).collect())
