"""Joins, aggregates and graph operators on DataFrames of sites, edges and routes."""
