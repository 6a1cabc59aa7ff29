"""A PySpark engine for exploring tables, logs and documents."""
