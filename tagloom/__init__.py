"""tagloom: curation of annotated item collections as Spark DataFrames."""

__version__ = "0.1.0"
