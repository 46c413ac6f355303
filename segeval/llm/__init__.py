"""Operations on training data: fingerprints, mixing, near-duplicates, quality, personal data, lines, shards, search, packing and token files."""
