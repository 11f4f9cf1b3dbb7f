"""emberline: security and fraud analytics expressed as Spark DataFrame operators."""
