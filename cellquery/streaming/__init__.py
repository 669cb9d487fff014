"""The harvest over pages that keep arriving."""
