"""Readers and writers: layout JSON, markdown, spans, bundles, manifests."""
