"""Column expressions: hashing, time text, geometry, envelopes and reference systems."""
