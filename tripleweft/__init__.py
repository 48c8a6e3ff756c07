"""Knowledge-graph analytics as Spark DataFrame plans."""
