"""Lead-intelligence pipelines for B2B export sales, written as Spark DataFrame operators."""
