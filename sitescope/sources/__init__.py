"""Scans and sinks: HTML pages, robots.txt, sitemaps, search rows, line-based lists."""
