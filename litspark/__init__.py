"""Literature and trial analytics as declarative Spark plans."""
