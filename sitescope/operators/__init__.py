"""Operators on crawl, issue and search relations: functions from DataFrames to DataFrames."""
