"""kinweave: record linkage and master-index jobs as PySpark tables in, tables out."""

__version__ = "0.1.0"
