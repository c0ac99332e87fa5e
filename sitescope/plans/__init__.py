"""Settings and the context of an analysis: pages, links and job facts with their derived columns."""
