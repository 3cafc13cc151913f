"""Training-data operators: language id, near-duplicate join, mixing, media, quality, decontamination,
HTML extraction, language-model scoring, repeated-substring removal and toxicity.

Nothing outside this subpackage imports it.
"""
