"""Column-level functions: text cleaning, tokens, dates, casts and scoring, all as native Spark expressions."""
