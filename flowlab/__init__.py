"""Labelled network-flow analytics on Spark."""
