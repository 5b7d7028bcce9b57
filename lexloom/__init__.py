"""Corpus cleaning for language-model training, expressed as Spark plans."""
