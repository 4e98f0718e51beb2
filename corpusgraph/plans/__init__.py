"""Stages composed into pipelines, and the queries over the test tables."""
