"""Environmental time series, coded river networks and station models as Spark DataFrame operators."""
