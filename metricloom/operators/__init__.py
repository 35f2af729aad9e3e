"""The operators of the metric engine as DataFrame transformations."""
