"""Operators over keyed, versioned relations: DataFrames in, DataFrames out."""
