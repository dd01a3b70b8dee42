"""Prescriptive supply-chain analytics as Spark DataFrame operators."""
