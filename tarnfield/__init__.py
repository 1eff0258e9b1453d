"""A PySpark library for feature engineering and dataset audits over nested and relational data."""
