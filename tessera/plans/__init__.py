"""What the driver knows of a dataset (its layout) and how it is worked out."""
