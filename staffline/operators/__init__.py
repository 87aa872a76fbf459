"""DataFrame operators: cleaning, decoding, statistics, histories, features."""
