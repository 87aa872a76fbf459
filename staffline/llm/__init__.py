"""Operators for building training corpora: quality, near copies, secrets, mixing,
packing, token files, exact search, HTML extraction and toxicity."""
