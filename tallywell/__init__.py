"""Report metrics and their reconciliation as lazy PySpark DataFrame functions."""
