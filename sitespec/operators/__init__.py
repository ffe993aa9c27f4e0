"""Table operators: DataFrame in, DataFrame out; every frame keeps ``domain``."""
