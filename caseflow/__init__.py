"""Card-fraud and customer-incident analytics as PySpark DataFrame and streaming operators."""
