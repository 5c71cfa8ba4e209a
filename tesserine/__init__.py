"""Document retrieval and evidence analytics expressed as Spark DataFrame operators."""
