"""Operations of a training-data pipeline: search, archives, language, tokens, cleaning, mixing, packing."""
