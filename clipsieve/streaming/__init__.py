"""Incremental batches: re-analyse only the sources whose signature changed."""
