"""Tables to linked data and back, as Spark DataFrame operators."""
