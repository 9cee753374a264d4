"""Collected pages, documents and operational events as Spark DataFrames."""
