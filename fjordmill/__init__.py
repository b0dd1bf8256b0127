"""fjordmill: DataFrame-to-DataFrame operators for scientific result tables on Apache Spark."""
