"""Guardlake: screening of texts, chats and agent tool-call logs on Spark DataFrames."""

__version__ = "0.1.0"
