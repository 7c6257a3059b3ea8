"""windrow: timed-text analytics expressed as Spark DataFrame plans."""
