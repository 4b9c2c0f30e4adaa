"""Operations of a training-data pipeline: scoring, counting, cleaning, deduplication, mixing and writing of text corpora."""
