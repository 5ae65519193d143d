"""textloom: exact substring analytics over document collections, on Spark DataFrames."""

from .operators.grams import GramIndex
from .plans.facades import CollectionSearch, TextSearch
from .sources.corpus import Corpus

__all__ = ["CollectionSearch", "Corpus", "GramIndex", "TextSearch"]
