"""Training-data operators: mixing, personal data, packing, archives, quality, copies, lists and licences."""
