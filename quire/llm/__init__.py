"""Training-data operators: quality, dedup, decontamination, secrets, licences, packing and classifiers."""
