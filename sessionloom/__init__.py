"""Session-evidence analytics on PySpark: ingest, project, maintain and query agent-session logs."""

__version__ = "0.1.0"
