"""Structural image features on Spark: planes, bitboard masks, morphology, histograms, learners."""
