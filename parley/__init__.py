"""Conversation histories as DataFrames: decode, merge, view, replay and prompt building on Spark."""
