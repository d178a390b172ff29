"""Operations of a training-data pipeline: decontamination, deduplication, filters, fixity and tokenising."""
