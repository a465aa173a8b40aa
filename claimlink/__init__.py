"""PySpark jobs for evidence-linked facts."""
