"""readloom: sequencing-read analytics expressed as Spark DataFrame plans."""
