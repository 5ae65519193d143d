"""DataFrame operators: search, gram index, sequences, suffixes."""
