"""Operators for building training corpora at scale (see README, "Training-data operators")."""
