"""A PySpark engine for structured data drawn from documents."""
