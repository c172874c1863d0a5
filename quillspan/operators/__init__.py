"""DataFrame operators: DataFrame in, DataFrame out."""
