"""Spark-native preparation and evaluation of question-answering and instruction data."""
