"""Spark jobs that turn source files of many repositories into queryable tables."""
