"""quire: a Spark-first engine that turns laid-out documents into paragraph records."""
