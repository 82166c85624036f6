"""factloom: knowledge-drift analytics as Spark DataFrame plans."""
