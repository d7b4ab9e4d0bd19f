"""Paged-document analytics as Spark jobs: manifests, search, headings, outlines."""
