"""What a query becomes: the choice between scan and index, and the facades that return plain values."""

from .facades import CollectionSearch, TextSearch

__all__ = ["CollectionSearch", "TextSearch"]
