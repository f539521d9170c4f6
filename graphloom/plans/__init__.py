"""Pipelines: solvers, applications, configuration, command line and the query catalogue."""
