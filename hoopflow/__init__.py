"""hoopflow: spatio-temporal tracking and event analytics as PySpark DataFrame operators."""
