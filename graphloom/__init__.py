"""Graphloom: code-graph and corpus analytics as plain Spark DataFrame operators."""
