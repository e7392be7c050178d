"""Spark-native engine for collections of Markdown notes."""
