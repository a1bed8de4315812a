"""larkspur: an analytics library of DataFrame -> DataFrame operators for PySpark."""
