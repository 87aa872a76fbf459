"""The staff sources and how each becomes a processed table."""
