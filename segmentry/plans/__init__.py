"""End-to-end runs: segments, opportunity scores, pain points."""
