"""Composed plans: index build, retrieval and answering, regression run, query catalogue."""
