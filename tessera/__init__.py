"""Bilingual text analytics on PySpark."""
