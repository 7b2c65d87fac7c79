"""Report formats, manifests and source text as tables."""
