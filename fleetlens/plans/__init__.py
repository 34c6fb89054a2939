"""Jobs that chain operators: feature building, training, validation."""
