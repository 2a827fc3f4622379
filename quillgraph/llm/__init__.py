"""Operations of a training-data pipeline, each one a module with its own operator."""
