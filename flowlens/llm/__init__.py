"""Operators for building language-model training data; see README, section "Training-data operators"."""
