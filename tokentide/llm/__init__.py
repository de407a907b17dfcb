"""Operations of a training-data pipeline, each a function between DataFrames."""
