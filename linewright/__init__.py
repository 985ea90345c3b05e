"""linewright: log-line and text analytics expressed as Spark DataFrame plans."""
