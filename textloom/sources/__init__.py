"""Where corpora come from, and the tables that hold them."""

from .corpus import Corpus
from .store import saved, shared_dir

__all__ = ["Corpus", "saved", "shared_dir"]
