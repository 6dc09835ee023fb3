"""Market-structure analytics over bar tables and streams, written as Spark DataFrame operators."""
