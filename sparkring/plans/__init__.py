"""Iterative algorithms; every round is one Spark job whose result is written to the shared folder."""
