"""tidemark: curation of instruction-tuning data on Spark DataFrames."""

__version__ = "0.1.0"
