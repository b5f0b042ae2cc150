"""Night-light reliability analytics and corpus preparation as PySpark DataFrame operators."""
