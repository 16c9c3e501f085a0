"""Training-data operators: dedup, quality, decontamination, secrets, HTML, sharding, ANN, language, BPE."""
