"""Corpus reconstruction engine expressed as Spark DataFrame plans."""
