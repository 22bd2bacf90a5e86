"""Program-inventory analytics expressed as Spark plans."""
