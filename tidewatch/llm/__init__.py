"""Training-data operators: duplicates, classifiers, mixing, packing, archives."""
