"""Token analytics and set-answer evaluation as PySpark DataFrame operators."""
