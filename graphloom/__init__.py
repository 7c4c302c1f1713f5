"""Knowledge-graph comparison and data preparation as Spark plans."""
